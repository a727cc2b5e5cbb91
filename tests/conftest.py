from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from cartulary.semantics import Tuning  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(params=["plain", "split"])
def tuning(request):
    """Both layouts: joins as Spark chooses, and every lookup and hot key split."""
    if request.param == "plain":
        return Tuning()
    return Tuning(broadcast_bytes=-1, hot_rows=2)


class Builder:
    """Small catalog tables from Python values."""

    def __init__(self, spark):
        self.spark = spark

    def _frame(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    def users(self, *ids, emails=None):
        emails = emails or {}
        rows = [
            (i, f"name {i}", json.dumps({"email": emails[i]} if i in emails else {}), "{}", None)
            for i in ids
        ]
        return self._frame(
            rows,
            "id string, display_name string, logical_id string, properties string, activity string",
        ).selectExpr(
            "*",
            "CAST(NULL AS STRING) AS asset_followers",
            "CAST(NULL AS TIMESTAMP) AS _created_at",
            "CAST(NULL AS TIMESTAMP) AS last_modified_at",
        )

    def resources(self, **names):
        rows = [
            (i, json.dumps({} if name is None else {"name": name, "description": {"text": f"about {name}"}}))
            for i, name in names.items()
        ]
        return self._frame(rows, "id string, user_defined_resource_info string")

    def datasets(self, *rows):
        """Each row a dict of id and any of tags, followers, contacts (JSON values), schema, flag."""

        def doc(value, name):
            return None if value is None else json.dumps({name: value})

        values = [
            (
                r["id"],
                r.get("flag", False),
                json.dumps({"name": r["id"], "platform": "P"}),
                json.dumps(r.get("schema", {"fields": []})),
                doc(r.get("followers"), "followedBy"),
                doc(r.get("contacts"), "contacts"),
                r["raw_tags"] if "raw_tags" in r else doc(r.get("tags"), "governedTagIds"),
            )
            for r in rows
        ]
        schema = (
            "id string, is_non_prod boolean, logical_id string, schema string, "
            "asset_followers string, asset_contacts string, asset_governed_tags string"
        )
        return self._frame(values, schema).selectExpr(
            "*",
            "'DATASET' AS entity_type",
            *(
                f"CAST(NULL AS TIMESTAMP) AS {c}"
                for c in ("_created_at", "last_modified_at", "last_ingested_at")
            ),
            *(
                f"CAST(NULL AS STRING) AS {c}"
                for c in ("structure", "statistics", "source_info", "entity_upstream")
            ),
        )

    def cards(self, *rows):
        """Each row (id, info) or (id, info, deleted)."""
        values = [
            (r[0], json.dumps(r[1]), "2024-01-01 00:00:00" if len(r) > 2 and r[2] else None)
            for r in rows
        ]
        frame = self._frame(values, "id string, knowledge_card_info string, deleted string")
        return frame.selectExpr(
            "id", "knowledge_card_info", "CAST(deleted AS TIMESTAMP) AS deleted_at",
            *(
                f"CAST(NULL AS STRING) AS {c}"
                for c in ("asset_followers", "asset_contacts", "asset_governed_tags")
            ),
        )

    def namespaces(self, *rows):
        values = [(r[0], json.dumps(r[1])) for r in rows]
        return self._frame(values, "id string, namespace_info string").selectExpr(
            "*",
            *(
                f"CAST(NULL AS TIMESTAMP) AS {c}"
                for c in ("deleted_at", "_created_at", "last_modified_at")
            ),
            *(
                f"CAST(NULL AS STRING) AS {c}"
                for c in ("asset_followers", "asset_contacts", "asset_governed_tags")
            ),
        )

    def domain_assets(self, *rows):
        return self._frame(
            list(rows),
            "_id string, parent string, live_query_assets array<string>, selected_assets array<string>",
        )


@pytest.fixture
def build(spark):
    return Builder(spark)

"""Row counts known for the derived tables at sf0.01."""

import pytest
from pyspark.sql import functions as F

from cartulary import dataset_report, domain_classification, merged_descriptions, popular_queries
from cartulary.operators import refs
from oracles.fixtures import derived_catalog, derived_events

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return derived_catalog(spark, SF_DIR)


def test_reference_rows(tables):
    tags = refs.resolve_tags(refs.tag_ids(tables.datasets), tables.user_defined_resource)
    assert (tags.count(), tags.where("tag_name IS NULL").count()) == (2666, 54)
    followers = refs.resolve_followers(refs.follower_ids(tables.datasets), tables.users)
    assert (followers.count(), followers.where("email IS NULL").count()) == (3000, 181)
    contacts = refs.resolve_contacts(
        refs.contacts_long(tables.datasets), tables.user_defined_resource, tables.users
    )
    assert contacts.count() == 1336


def test_report_rows(tables):
    report = dataset_report(tables)
    assert report.count() == 3333
    assert dataset_report(tables, grain="asset").count() == tables.datasets.count()
    cards = merged_descriptions(tables).groupBy("id").agg(F.count("*").alias("k"))
    assert report.join(cards, "id").agg(F.sum("k")).first()[0] == 11325


def test_live_namespaces(tables):
    live = domain_classification(tables.namespaces.where("deleted_at IS NULL"))
    names = ("domain_name", "subdomain_name", "data_product_name")
    counts = [live.where(f"{n} <> ''").count() for n in names]
    assert [*counts, live.count() - sum(counts)] == [4, 53, 32, 6]


def test_top_searches(spark):
    top = popular_queries(derived_events(spark, SF_DIR), top=3).collect()
    assert [tuple(r) for r in top] == [("q5", 68), ("q32", 67), ("q1", 64)]

"""Box queries on fifty pages that grow with the parts equal their SQL where pages hold more than twenty parts."""

import duckdb
import pytest

from gradus.plans import registry
from gradus.plans import views as V

SF = "/root/testdata/sf0.01"
NAMES = ["pair_score", "text_owner", "nearby_outputs", "join_caption", "join_best_image", "join_label_in_box"]


def test_pages_grow_with_the_parts(spark):
    truth, found = V.boxes(spark, SF)
    assert {r["count"] for r in truth.union(found).groupBy("page").count().collect()} == {40}


@pytest.mark.parametrize("name", NAMES)
def test_places_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    assert "% 50 AS page" in registry.ORACLES[name]
    rel = con.execute(registry.ORACLES[name])
    cols = [d[0] for d in rel.description]
    near = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert near(registry.QUERIES[name](spark, SF).select(*cols).collect()) == near(rel.fetchall())

"""The fold against cleaning all that is held with each batch; replays, failures, and what a batch reads."""

import glob
import os
import random

from pyspark.sql import functions as F

from gristmill.operators.products import clean
from gristmill.sources.tables import RAW_OFFERS, state_folder, written
from gristmill.streaming.fold import ProductState, fold_batches

SCHEMA = "ord bigint, sku_upc string, product_name string, color string, msrp string, qty string, your_cost string, notes string, product_image string, source string, source_detail string, category string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def batch(spark, rows):
    return spark.createDataFrame([tuple({"ord": i, **{c: "" for c in COLUMNS[1:]}, **r}[c] for c in COLUMNS) for i, r in rows], SCHEMA)


def test_fold_equals_cleaning_all_that_is_held(spark):
    assert set(COLUMNS) == {c for c in COLUMNS if c in RAW_OFFERS}
    draw = random.Random(4)
    words = ["Trail Mug", "Trail Mug 12 oz", "Trail Mug 12 oz blue lid", "TR", "Tr1", "Pan 5", "Pan 55 set", "Cup X1"]
    rows = [(i, {"sku_upc": draw.choice(["", "", f"A{draw.randrange(9)}00"]), "product_name": draw.choice(words), "msrp": draw.choice(["$5", "", "7.5"]), "color": draw.choice(["", "Red"]), "notes": draw.choice(["", "n"]), "product_image": draw.choice(["", "http://x"])}) for i in range(60)]
    parts = [rows[:20], rows[20:21], [], rows[21:45], rows[45:]]
    held = None
    for part in parts:
        both = batch(spark, part) if held is None else held.unionByName(batch(spark, part))
        held = written(clean(both), "held")
    found = fold_batches([batch(spark, p) for p in parts], state_folder(spark), buckets=4)
    assert sorted(map(str, found.select(*COLUMNS).collect())) == sorted(map(str, held.select(*COLUMNS).collect()))


def test_replay_failure_and_what_is_read(spark):
    folder = state_folder(spark)
    path = folder.removeprefix("file://")
    state = ProductState(spark, folder, buckets=16)
    first = batch(spark, [(i, {"sku_upc": f"SKU-{i}", "product_name": f"{chr(97 + i % 26)}{i} thing", "msrp": "$5"}) for i in range(200)])
    assert state.fold(first, 0) and not state.fold(first, 0)
    rows = lambda s: sorted(map(str, s.products(SCHEMA).collect()))
    before, versions = rows(state), dict(state.versions)
    again = ProductState(spark, folder, buckets=16)
    assert again.last == 0 and not again.fold(first, 0) and rows(again) == before
    # what a batch wrote before it failed is not seen, and written anew
    os.makedirs(f"{path}/rows/batch=1/bucket=3")
    assert rows(again) == before
    assert again.fold(batch(spark, [(900, {"sku_upc": "SKU-7", "product_name": "h7 thing", "color": "", "qty": "4"})]), 1)
    changed = {k for k in again.versions if versions.get(k) != again.versions[k]}
    assert len([k for k in changed if k[0] == "rows"]) == 1 and len([k for k in changed if k[0] == "names"]) <= 2
    assert len(rows(again)) == 200 and ProductState(spark, folder, buckets=16).last == 1
    # the buckets that it replaced are gone
    (bucket,) = (b for k, b in changed if k == "rows")
    assert not os.path.exists(f"{path}/rows/batch=0/bucket={bucket}") and glob.glob(f"{path}/rows/batch=1/bucket={bucket}/*.parquet")
    assert again.products(SCHEMA).filter(F.col("sku_upc") == "SKU-7").first()["msrp"] == "$5.00"

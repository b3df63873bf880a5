"""Documents whose form is not known beforehand."""

import json

from pyspark.sql import functions as F

from tesserae.sources import documents as D


def test_documents_without_a_schema(spark, tmp_path):
    docs = {
        "a": {"cells": [{"bbox": [[1, 2], [3, 4]], "id": 7}, {"bbox": "none", "id": "x"}, None], "meta": {"mpp": 0.5, "odd key": "k", "who.dot": True}},
        "b": {"cells": [], "meta": {"mpp": "unknown", "tags": ["u", 1]}, "extra": None},
        "c": {"meta": {"deep": {"er": 12345678901}}},
    }
    for name, doc in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "d.json").write_text('{"cells": [')
    (tmp_path / "e.json").write_text("")
    read = D.read_variants(spark, str(tmp_path)).withColumn("document", F.regexp_extract("document", r"(\w)\.json$", 1))
    assert {r["document"]: r["bad"] for r in read.select("document", F.isnull("value").alias("bad")).collect()} == {"a": False, "b": False, "c": False, "d": True}
    cells = D.variant_rows(read, "$.cells", {"y": "$.bbox[0][0] double", "id": "$.id bigint"}).collect()
    assert sorted(map(tuple, cells), key=lambda r: r[1]) == [("a", 0, 1.0, 7), ("a", 1, None, None), ("a", 2, None, None)]
    flat = {r["document"]: r.asDict() for r in D.flatten_variants(read).collect()}
    assert set(flat["a"]) == {"document", "cells", "extra", "meta.mpp", "meta.odd key", "meta.who.dot", "meta.tags", "meta.deep.er"}
    assert flat["a"]["meta.odd key"] == "k" and flat["a"]["meta.who.dot"] is True and json.loads(flat["a"]["cells"]) == docs["a"]["cells"]
    assert (flat["a"]["meta.mpp"], json.loads(flat["b"]["meta.mpp"])) == ("0.5", "unknown") and json.loads(flat["b"]["meta.tags"]) == ["u", 1]
    assert flat["c"]["meta.deep.er"] == 12345678901 and flat["c"]["cells"] is None and set(flat["d"].values()) == {"d", None}
    assert D.flatten_variants(read.where("document = 'd'")).columns == ["document"]
    assert D.flatten_variants(read.where("document = 'z'")).count() == 0


def test_slide_files_lie_in_one_folder(spark, tmp_path):
    """One document a file, but not a folder a file, which would be listed and moved one by one; no customers give no rows."""
    from tesserae.plans import QUERIES, join_queries as Q

    customers = spark.range(2000).selectExpr("id as c_custkey", "concat('c', id) as c_name", "cast(id % 3 as int) as c_nationkey", "cast(id as double) as c_acctbal", "'x' as c_mktsegment")
    customers.write.parquet(f"{tmp_path}/some/customer.parquet")
    customers.limit(0).write.parquet(f"{tmp_path}/none/customer.parquet")
    files = spark.read.text(Q._slides(spark, f"{tmp_path}/some"), wholetext=True).select(F.regexp_extract("_metadata.file_path", "^(.*)/[^/]*$", 1).alias("folder"), F.get_json_object("value", "$.wsi_metadata").alias("slide"))
    assert files.count() == files.distinct().count() == 3 * 4
    assert files.select("folder").distinct().count() == 1
    for name in ("s12_whole_files", "s12_variant_rows"):
        assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0
    assert QUERIES["s12_variant_rows"](spark, f"{tmp_path}/some").count() == 2000

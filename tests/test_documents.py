"""JSON documents cut by byte ranges: equal to what a parser of the whole text finds, wherever the cuts fall."""

import json
import random

import pytest
from pyspark.sql import functions as F

from orbitweave.sources import documents, files, sinks

ODD = ["a", 'b"q', "c\\", "{x}", "[y", "z}]", '\\"}', 'é"\\\\', "", "}{" * 20]


def _document(rng):
    def item(k):
        o = {"id": k, "name": rng.choice(ODD), "box": [1, [2, 3], {"v": rng.choice(ODD)}]}
        return o | ({"odd": {"in": {"deep": [{"x": 1}]}, "t": "}{"}} if rng.random() < 0.3 else {})

    return {
        "info": {"v": 1, "in": {"a": {}}, "s": "x}y"}, "images": [item(k) for k in range(rng.randint(0, 25))], "version": "1", "licenses": [],
        "annotations": [item(k) for k in range(rng.randint(0, 60))], "flag": True, "categories": [{"id": 1}], "tail": {"q": [{"a": 1}, []]},
    }


@pytest.mark.parametrize("seed", range(4))
def test_objects_equal_a_whole_parse(spark, tmp_path, seed):
    rng = random.Random(seed)
    doc = _document(rng)
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=seed % 2 == 0) + rng.choice(["", "\n"]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (331, 5000, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(most))
            rows = documents.read_objects(spark, str(tmp_path / "d.json")).collect()
            for name in ("images", "annotations", "categories", "licenses"):
                assert [json.loads(r.json) for r in sorted((r for r in rows if r.section == name), key=lambda r: r.ordinal)] == doc[name]
            assert [json.loads(r.json) for r in rows if r.section is None] == [{k: [] if isinstance(v, list) else v for k, v in doc.items()}]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_several_documents_in_a_folder(spark, tmp_path):
    rng = random.Random(7)
    docs = [_document(rng) for _ in range(3)]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
    back = files.read_coco(spark, str(tmp_path), one_document=False)
    assert sorted(r.id for r in back["images"].collect()) == sorted(i["id"] for d in docs for i in d["images"])
    assert back["document"].count() == 3


def test_written_document_is_json_and_keeps_unknown_keys(spark, tmp_path):
    path = str(tmp_path / "out")
    k = F.col("id")
    images = spark.range(1, 300).select(k.cast("int").alias("id"), F.concat(F.lit('n"}{'), k.cast("string")).alias("file_name"))
    extra = F.when(k % 3 > 0, F.create_map(F.lit("odd"), F.parse_json(F.to_json(F.struct(k.alias("a"), F.lit("}\\").alias("b"))))))
    annotations = spark.range(1, 900).select(k.cast("int").alias("id"), (k % 300).cast("int").alias("image_id"), extra.alias("extra"))
    none = spark.createDataFrame([], "id int, name string")
    sinks.write_coco(images, annotations, none, path, spark.createDataFrame([(1, "free")], "id int, name string"), partitions=5)
    parts = sorted((tmp_path / "out").glob("part-*"))
    doc = json.loads("".join(p.read_text() for p in parts))
    assert len(parts) > 2 and [i["id"] for i in doc["images"]] == list(range(1, 300)) and doc["categories"] == []
    assert doc["annotations"][0] == {"id": 1, "image_id": 1, "odd": {"a": 1, "b": "}\\"}} and doc["annotations"][2] == {"id": 3, "image_id": 3}
    back = files.read_coco(spark, path)
    odd = F.variant_get(F.col("extra")["odd"], "$.a", "long")
    assert {(r.id, r.a) for r in back["annotations"].select("id", odd.alias("a")).collect()} == {(n, n if n % 3 else None) for n in range(1, 900)}
    assert back["licenses"].first().name == "free" and back["categories"].count() == 0


def test_empty_file_and_document(spark, tmp_path):
    for k, text in enumerate(["", "{}", " {\n} ", '{"images": []}', '{"a": "}"}']):
        (tmp_path / f"{k}.json").write_text(text)
        rows = documents.read_objects(spark, str(tmp_path / f"{k}.json")).collect()
        assert [json.loads(r.json) for r in rows] == ([json.loads(text)] if text else [])

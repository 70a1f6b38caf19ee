"""Whole flows: files to chunks and registry; notebooks to summaries and scripts."""

import hashlib
import uuid

import pandas as pd
from pyspark.sql import functions as F
from test_functions import docx

from lectern.operators import ingest as ing
from lectern.operators import overview
from lectern.sources import files as fs


def test_ingest_then_again(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    long = "A text about databases. " * 120
    for name, content in {"a.txt": long.encode(), "copy.md": long.encode(), "blank.txt": b" \n", "bad.docx": b"PK\x03\x04 no", "scan.docx": docx("few words", images=[b"img"]), "odd.xyz": b"?"}.items():
        (folder / name).write_bytes(content)
    files = fs.read_files(spark, str(folder))
    entries = spark.createDataFrame([], "content_hash string, collection string, extracted_text string, char_count int")
    stored = spark.createDataFrame([], "content_hash string")
    made = ing.ingest(files, entries, stored)
    got = {r.filename: r for r in made.results.collect()}
    assert {n: r.status for n, r in got.items()} == {"a.txt": "ready", "copy.md": "ready", "blank.txt": "partial", "bad.docx": "failed", "scan.docx": "ready", "odd.xyz": "failed"}
    assert got["blank.txt"].error_message == ing.NO_TEXT and got["scan.docx"].ocr_used and got["a.txt"].char_count == len(long)
    paths = str(tmp_path / "chunks"), str(tmp_path / "entries")
    ing.store(made, *paths)
    chunks, entries = (spark.read.parquet(p) for p in paths)
    assert entries.count() == 2 and chunks.where("filename = 'a.txt'").count() == 4 and chunks.first().embedding and ing.orphan_chunks(chunks, entries).count() == 0
    again = ing.ingest(files, entries, chunks)
    assert {r.action for r in again.results.where("filename in ('a.txt', 'copy.md', 'scan.docx')").collect()} == {"cached"} and again.chunks.count() == 0 and again.entries.count() == 0
    lost = ing.ingest(files, entries, chunks.where("filename <> 'a.txt'"))
    assert lost.chunks.count() == 4 and lost.results.where("filename = 'a.txt'").first().action == "rebuild"


def test_a_content_is_parsed_once_for_results_chunks_and_entries(spark, tmp_path):
    log = tmp_path / "parsed"
    log.mkdir()

    @F.pandas_udf(fs.PARSED)
    def parse(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        (log / uuid.uuid4().hex).write_bytes(b"".join(c + b"\n" for c in contents))
        return pd.DataFrame({"text": [c.decode() for c in contents], "page_count": pd.array([None] * len(contents), "Int32"), "images": [[]] * len(contents), "error": None})

    rows = [(f"{k}.txt", f"text {k % 5}".encode(), f"h{k % 5}", "txt") for k in range(10)]
    files = spark.createDataFrame(rows, "filename string, content binary, content_hash string, content_type string")
    nothing = spark.createDataFrame([], "content_hash string, extracted_text string")
    made = ing.ingest(files, nothing, nothing.select("content_hash"), parse=parse)
    paths = str(tmp_path / "chunks"), str(tmp_path / "entries")
    ing.store(made, *paths)
    assert made.results.where("status = 'ready'").count() == 10 and [spark.read.parquet(p).count() for p in paths] == [5, 5]
    assert sorted(x for f in log.iterdir() for x in f.read_text().split("\n") if x) == [f"text {k}" for k in range(5)]


def test_summaries(spark):
    notebooks = spark.createDataFrame([(1, "old", '["q"]', "s1"), (2, "old", None, "changed"), (3, None, None, None)], "notebook_id long, summary string, suggested_questions string, content_signature string")
    signatures = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "notebook_id long, signature string")
    texts = spark.createDataFrame([(1, 1, "one"), (2, 2, "two")], "id long, notebook_id long, text string")
    said = F.concat(F.lit('{"summary": "'), F.element_at("texts", 1), F.lit('", "suggested_questions": ["a"]}'))
    got = {r.notebook_id: (r.summary, r.suggested_questions, r.content_signature, r.skipped) for r in overview.summaries(notebooks, signatures, texts, said).collect()}
    assert got == {1: ("old", ["q"], "s1", True), 2: ("two", ["a"], "s2", False), 3: (overview.NO_SOURCES, [], "s3", False)}
    stored = spark.range(1).select(overview.stored_questions(F.array(F.lit("q"))), overview.stored_questions(F.array().cast("array<string>"))).first()
    assert tuple(stored) == ('["q"]', None)


def test_scripts_and_media(spark):
    texts = spark.createDataFrame([(2, 7, "second"), (1, 7, "first text")], "id long, notebook_id long, text string")
    chosen = overview.selected_texts(texts)
    assert chosen.first().texts == ["first text", "second"]
    mark = hashlib.sha256(b"7:first text").hexdigest()[:8]
    row = chosen.select(overview.stand_in_dialogue(F.col("notebook_id"), F.col("texts")).alias("d"), overview.stand_in_slides(F.col("notebook_id"), F.col("texts")).alias("s")).first()
    assert [t.host for t in row.d] == list("ABABAB") and mark in row.d[0].text and len(row.s) == 5 and row.s[0].heading.endswith(f"[{mark}]")
    said = spark.createDataFrame([(1, True), (1, False), (2, False)], "notebook_id long, ok boolean")
    assert {r.notebook_id: (r.n_ok, r.status) for r in overview.media_outcome(said).collect()} == {1: (1, "ready"), 2: (0, "failed")}
    slides = spark.createDataFrame([(1, 0, "a.png", 3.21), (1, 1, "b.png", None)], "notebook_id long, pos int, image string, audio_seconds double")
    assert [r.duration for r in overview.manifest(slides).orderBy("pos").collect()] == [3.7, 5.0]
    sizes = spark.createDataFrame([(1, 5), (11 << 20, 5), (1, 61)], "size long, seconds int")
    assert [r[0] for r in sizes.select(overview.audio_verdict(F.col("size"), F.col("seconds"))).collect()] == [None, "Audio upload exceeds 10 MB limit.", "Audio exceeds 60s recording limit."]

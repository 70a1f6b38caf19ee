"""Column functions on the golden cases, and against plain Python."""

import hashlib
import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.functions import chunk, embed, generate, guard, hashing, markdown, scripts, text
from lectern.sources import files
from lectern.sources.config import Options


@pytest.fixture
def value(spark):
    """Evaluate a column function on literal arguments."""

    def run(function, *args):
        names = [f"c{k}" for k in range(len(args))]
        kinds = {str: "string", int: "int", bool: "boolean", bytes: "binary", bytearray: "binary", float: "double", type(None): "string", list: "array<string>"}
        schema = ", ".join(f"{n} {kinds[type(a)]}" for n, a in zip(names, args))
        return spark.createDataFrame([Row(*args)], schema).select(function(*map(F.col, names)).alias("x")).first().x

    return run


def test_names(value):
    assert value(hashing.collection_name, "a" * 64) == "doc_" + "a" * 59
    assert value(lambda h: hashing.chunk_id(h, F.lit(3)), "b" * 64) == "b" * 16 + "_3"


@pytest.mark.parametrize("name,kind", [("report.PDF", "pdf"), ("README.MD", "md"), ("a.b.txt", "txt"), ("file.xyz", None), ("noextension", None), (".md", None), ("x.", None)])
def test_content_type(value, name, kind):
    assert value(text.content_type, name) == kind


@pytest.mark.parametrize("path,name", [("a/b/c.txt", "c.txt"), ("../..", None), ("a/.", None), ("", None), ("x/", "x"), ("plain", "plain")])
def test_basename(value, path, name):
    assert value(text.basename, path) == name


def test_magic(value):
    ok = lambda content, kind: value(lambda c, k: text.magic_ok(c, k), bytearray(content), kind)
    assert ok(b"%PDF-1.7", "pdf") and not ok(b"PDF", "pdf") and ok(b"PK\x03\x04x", "docx") and not ok(b"PK", "pptx")
    assert ok(b"", "txt") and ok(b"\x10\x0a\xa0" * 50, "md") and not ok(b"a\x00", "txt") and ok(b"a" * 4096 + b"\x00", "txt") and not ok(b"x", "exe")


SOURCES = ["Machine learning is a field of artificial intelligence."]


@pytest.mark.parametrize(
    "question,texts,want",
    [
        ("What is machine learning?", SOURCES, True), ("What's the weather like today?", SOURCES, False), ("", SOURCES, False), ("  \n", SOURCES, False), ("What is machine learning?", [], False),
        ("Hello there", SOURCES, False), ("How do I cook pasta?", SOURCES, False), ("Are cookies machine made?", SOURCES, False), ("the and of", SOURCES, False), ("quantum chromodynamics", SOURCES, False),
        ("history of learning", SOURCES, True), ("hi", SOURCES, False), ("hiking machine", SOURCES, True), (None, SOURCES, False),
    ],
)
def test_scope(value, question, texts, want):
    assert value(lambda q, s: guard.is_in_scope(q, guard.meaningful_words(s)), question, " ".join(texts)) == want


CONTEXT = "The sky is blue and the grass is green."


@pytest.mark.parametrize(
    "answer,context,ok,note",
    [
        ("The sky is blue.", CONTEXT, True, ""), ("", CONTEXT, True, ""), ("Something said here", "", False, guard.NOT_VERIFIED), ("to be or", CONTEXT, True, ""),
        ("Blue sky elephants dance tango", CONTEXT, False, guard.NOT_FULLY_VERIFIED), ("Words stand here", "of to", False, guard.NOT_VERIFIED), ("blue tango", CONTEXT, True, ""),
    ],
)
def test_groundedness(value, answer, context, ok, note):
    out = value(lambda a, c: guard.groundedness(a, c), answer, context)
    assert (out.grounded, out.result) == (ok, answer + note)


def test_stopwords():
    assert len(guard.STOPWORDS) == len(set(guard.STOPWORDS)) == 120 and len(guard.OFF_TOPIC) == 15 and len(guard.GREETINGS) == 7


def python_spoken(x):
    for pattern, to in text.SPOKEN:
        flags = re.IGNORECASE * ("i)" in pattern[:6]) | re.MULTILINE * ("m)" in pattern[:6])
        x = re.sub(re.sub(r"^\(\?\w+\)", "", pattern), to.replace("$1", r"\1"), x, flags=flags)
    return x.strip()


@pytest.mark.parametrize(
    "raw,want",
    [
        ("It is reliable [Source 3].", "It is reliable."), ("**bold** and *it* __u__", "bold and it u"), ("`code` x", "code x"), ("## Head\ntext", "Head\ntext"), ("[link](http://x) y", "link y"),
        ("a\n\n\n\nb", "a\n\nb"), ("- one\n* two", "one\ntwo"), ("", ""), ("é*x*", "é*x*"), ("x [source 1, Source 22] , y", "x, y"), ("```python\ncode\n```\nz", "code\nz"), ("a\n---\nb", "a\n\nb"),
    ],
)
def test_spoken(value, raw, want):
    assert value(text.spoken, raw) == want == python_spoken(raw)


def test_spoken_over_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", text.spoken(F.col("html")).alias("x")).collect()
    assert all(r.x == python_spoken(r.html) for r in rows)


def test_small_text_functions(value):
    assert [value(text.voice_of, x) for x in ("Ava", "Ryan", "Nobody", "")] == ["en-US-AvaNeural", "en-US-RyanNeural", "en-US-AvaNeural", "en-US-AvaNeural"]
    assert value(text.final_answer, "<|channel|thought\nhm\n<channel|>The final answer.") == "The final answer."
    assert value(text.final_answer, "<|channel|thought x <|channel|>") == "<|channel|thought x <|channel|>"
    assert value(text.strip_fences, "x ```json\n{1}\n``` y ```b```") == "{1}"
    assert value(lambda x: text.strip_fences(x, True), "x ```json\n{1}\n``` y ```b") == "{1}\n``` y"
    assert value(lambda x: text.strip_fences(x, True), "```json\n{1} ") == "{1}"
    assert value(lambda x: text.strip_fences(x, True), " plain ") == "plain"
    assert value(text.redact_url, "postgres://u:p@ss@h/db") == "postgres://***@h/db" and value(text.redact_url, "a@b") == "a@b"
    assert value(text.redact_secret, "k") == "<set>" and value(text.redact_secret, "") == "<unset>"
    assert value(text.as_bool, " YES ") is True and value(text.as_bool, "on") is False and value(lambda x: text.as_int(x, 7), "x") == 7 and value(lambda x: text.as_int(x, 7), "12") == 12
    assert value(lambda c: text.speech_seconds(c), 30000) == 200 and value(lambda c: text.speech_words(text.speech_seconds(c)), 30000) == 500
    assert value(lambda c: text.speech_seconds(c), 100) == 60 and value(lambda c: text.speech_seconds(c), 100000) == 480
    assert value(lambda f, p: text.citation_label(f, p), "a.txt", 2) == "a.txt p.2" and value(lambda f: text.citation_label(f, F.lit(None).cast("int")), "a.txt") == "a.txt"
    assert value(text.error_status, "HTTP 403 no") == 403 and value(text.retryable, "Read timed out") is True and value(text.retryable, "bad") is False
    assert value(text.sse_text, 'data: {"token":"a "}\n\nbad\ndata: {"token":"b"}\n\ndata: {"done":true}\n\n') == "a b"
    assert value(lambda t: text.sse_frame(F.struct(t.alias("token"))), 'é"') == 'data: {"token":"é\\""}\n\n'


def test_summary(value):
    out = value(scripts.summary, '```json\n{"summary": "S", "suggested_questions": ["1","2","3","4","5","6","7"]}\n```')
    assert out.summary == "S" and out.suggested_questions == list("12345")
    assert tuple(value(scripts.summary, " not json")) == (" not json", [])
    assert tuple(value(scripts.summary, "{}")) == ("", []) and tuple(value(scripts.summary, "")) == ("", [])
    assert tuple(value(scripts.summary, '{"summary": 3, "suggested_questions": "q"}')) == ("3", []) and value(scripts.summary, "[1]") is None


def test_dialogue(value):
    said = lambda x: [tuple(r) for r in value(scripts.dialogue, x)]
    turns = [{"host": h, "text": t} for h, t in (("host_a", "1"), ("host b", "2"), ("1", " 3 "), ("2", "4"), ("A", "  "))]
    assert said(json.dumps({"dialogue": [*turns, "x", {"text": "5"}]})) == [("A", "1"), ("B", "2"), ("A", "3"), ("B", "4"), ("A", "5")]
    assert said("nothing") == said("") == said('{"dialogue": 3}') == []
    # of broken JSON, only what closes the last utterance is cut off
    broken = '{"dialogue": [{"host": "Ava", "text": "He said "hi" to me"}, {"host": "B", "text": "x "y" z"}]'
    assert said(broken) == [("A", 'He said "hi" to me"}, {'), ("B", 'x "y" z')]
    alternated = value(lambda x: scripts.alternated(scripts.dialogue(x)), json.dumps({"dialogue": [{"host": "B", "text": "x"}, {"host": "B", "text": "y"}, {"host": "B", "text": "z"}]}))
    assert [r.host for r in alternated] == ["A", "B", "A"]


def test_slides(value):
    slides = [{"heading": " H ", "bullets": [" a ", "", "b"]}, {"heading": "  "}, {"type": "title", "heading": "T", "bullets": "no", "narration": " n "}, 5]
    got = [r.asDict() for r in value(scripts.slides, json.dumps({"slides": slides}))]
    assert got == [{"type": "content", "heading": "H", "bullets": ["a", "b"], "narration": "H"}, {"type": "title", "heading": "T", "bullets": [], "narration": "n"}]
    assert value(scripts.slides, "x") == value(scripts.slides, '{"slides": {}}') == []


def test_chunks(spark):
    assert chunk.chunk_text("") == chunk.chunk_text(" \n ") == chunk.chunk_text(None) == [] and chunk.chunk_text("Hello world") == ["Hello world"]
    assert len(chunk.chunk_text("word " * 2000)) == 13 and [len(c) for c in chunk.chunk_text("x" * 2500)] == [1000, 1000, 900]
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    made = {}
    for r in chunk.chunks(rows, F.col("text"), "doc_id").orderBy("doc_id", "chunk_index").collect():
        assert r.page == r.chunk_index + 1 and len(r.document) <= 1000
        made.setdefault(r.doc_id, []).append(r.document)
    for r in rows.collect():
        assert made.get(r.doc_id, []) == chunk.chunk_text(r.text)
        assert set(r.text.split()) == {w for c in made[r.doc_id] for w in c.split()} or len(made[r.doc_id]) > 1


def test_embedder(spark):
    a = embed.hash_vector("x")
    seed = hashlib.sha256(b"documentx").digest()
    raw = [b / 255.0 - 0.5 for i in range(32) for b in hashlib.sha256(seed + i.to_bytes(4, "big")).digest()]
    assert len(a) == 1024 and np.allclose(a, np.array(raw) / np.sqrt(np.dot(raw, raw))) and abs(np.linalg.norm(a) - 1) < 1e-9
    assert not np.allclose(a, embed.hash_vector("x", query=True)) and len(embed.hash_vector("x", 500)) == 500
    df = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    got = [r.v for r in df.select(embed.embedder(dimension=64)(F.col("t")).alias("v")).collect()]
    assert np.allclose(got[0], embed.hash_vector("x", 64), atol=1e-6) and got[1] is got[2] is None
    assert embed.last_token(np.arange(6).reshape(1, 2, 3)).tolist() == [3, 4, 5] and embed.last_token([1, 2]).tolist() == [1, 2]


def test_prompt_and_stand_ins(value):
    messages = value(lambda c, q: generate.prompt(F.lit("S"), c, q), "", "Q?")
    assert [tuple(m) for m in messages] == [("system", "<|think|>S"), ("user", "Q?")]
    with_context = value(lambda c, q: generate.prompt(F.lit("S"), c, q, False), "C", "Q?")
    assert with_context[0].content == "S" and with_context[1].content.endswith("Context:\nC\n\nQuestion: Q?")
    key = "system:<|think|>S|user:Q?"
    want = f"[mock answer {hashlib.sha256(key.encode()).hexdigest()[:8]}] Based on the provided sources, here is a response to: Q?."
    answer = value(lambda c, q: generate.stand_in_answer(generate.prompt(F.lit("S"), c, q)), "", "Q?")
    assert answer == want and value(generate.answer_tokens, " a  b\n") == ["a ", "b "]
    assert value(generate.speech_text, bytearray(b"x")).text.startswith(f"[mock transcription {hashlib.sha256(b'x').hexdigest()[:8]}]")
    assert value(lambda c: generate.image_text(c, "other"), bytearray(b"x")) == f"[mock OCR {hashlib.sha256(b'x').hexdigest()[:8]}]"


def test_retry_and_plug(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 2:
            raise RuntimeError("429 slow down")
        return x

    assert generate.with_retry(flaky)(5) == 5 and calls == [5, 5]
    with pytest.raises(ValueError):
        generate.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")))()
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r.u for r in generate.plugged(df, lambda: lambda xs: [x.upper() for x in xs], "t", "u").collect()] == ["A", "B"]


def test_markdown():
    out = markdown.render('## T\nline *a* `x<y`\nmore\n\n- **b**\n- c\n1. d\n> q\n> r\n---\n```py\n<k>\n```\n[l](https://e.x) [m](ftp://n) "z"')
    assert out == (
        '<h2 class="md-heading">T</h2><p>line <em>a</em> <code class="md-code">x&lt;y</code> more</p><ul class="md-list"><li><strong>b</strong></li><li>c</li></ul>'
        '<ol class="md-list"><li>d</li></ol><blockquote class="md-blockquote">q r</blockquote><hr class="md-hr"><pre class="md-code-block"><code>&lt;k&gt;</code></pre>'
        '<p><a href="https://e.x" target="_blank" rel="noopener noreferrer">l</a> [m](ftp://n) "z"</p>'
    )
    assert markdown.render("") == markdown.render(None) == ""
    assert markdown.wrap("aa bb cc", 5) == ["aa bb", "cc"] and markdown.wrap("", 5) == [] and markdown.wrap("abcdefgh i", 5) == ["abcdefgh", "i"]


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(*paragraphs, images=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return office({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", **{f"word/media/{k}.png": i for k, i in enumerate(images)}})


def pptx(*slides):
    p, a = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"', 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    ids = "".join(f'<p:sldId r:id="r{k}"/>' for k in range(len(slides)))
    relations = "".join(f'<Relationship Id="r{k}" Target="slides/s{k}.xml"/>' for k in range(len(slides)))
    parts = {"ppt/presentation.xml": f"<p:presentation {p} {r}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": f"<Relationships>{relations}</Relationships>"}
    return office(parts | {f"ppt/slides/s{k}.xml": f"<p:sld {p} {a}>" + "<p:cSld><p:spTree>" + "".join(f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for t in s) + "</p:spTree></p:cSld></p:sld>" for k, s in enumerate(slides)})


def test_files(spark, tmp_path):
    for name, content in {
        "a.docx": docx("One", " ", "Two", images=[b"img"]), "b.pptx": pptx(["T", "body"], [], ["last"]), "c.txt": b"x\xffy", "d.md": b"# h", "e.pdf": b"%PDF two pages", "f.docx": b"PK\x03\x04broken", "g.xyz": b"?",
    }.items():
        (tmp_path / name).write_bytes(content)
    rows = files.read_files(spark, str(tmp_path)).withColumn("p", files.parser(lambda content: ["p1", "p2"])(F.col("content"), F.col("content_type")))
    got = {r.filename: r for r in rows.collect()}
    assert got["a.docx"].p.text == "One\n\nTwo" and [bytes(x) for x in got["a.docx"].p.images] == [b"img"]
    assert got["b.pptx"].p.text == "T\nbody\n\nlast" and got["c.txt"].p.text == "x�y" and got["d.md"].p.text == "# h"
    assert (got["e.pdf"].p.text, got["e.pdf"].p.page_count) == ("p1\n\np2", 2) and got["f.docx"].p.error and got["g.xyz"].p.error
    assert got["c.txt"].content_hash == hashlib.sha256(b"x\xffy").hexdigest()
    assert files.media(b"no zip") == []


def test_ocr_columns(value):
    assert value(lambda t: files.joined_image_texts(t, "Page"), ["a", "", "c"]) == "[Page 1]\na\n\n[Page 3]\nc"
    assert tuple(value(lambda w, h: files.fitted_size(w, h), 4096, 1000)) == (2048, 500) and tuple(value(lambda w, h: files.fitted_size(w, h), 10, 20)) == (10, 20)
    need = lambda t, k, n: value(lambda a, b, c: files.needs_ocr(a, b, c), t, k, n)
    assert need("short", "pdf", 0) and not need("x" * 200, "pdf", 0) and need("", "docx", 1) and not need("", "docx", 0) and not need("", "txt", 3)
    assert value(files.data_url, bytearray(b"ab")) == "data:image/png;base64,YWI="


def test_options():
    got = Options.from_env({"LECTERN_TOP_K": "9", "LECTERN_OCR_ENABLED": "no", "LECTERN_CHUNK_SIZE": "x"})
    assert (got.top_k, got.ocr_enabled, got.chunk_size) == (9, False, 1000)

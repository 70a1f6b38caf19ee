"""Images and recordings: bytes read back, areas, tones, errors."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.plans import fixtures
from lectern.plans.queries import QUERIES
from lectern.sources import audio, images


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_rows_of_all_filters(channels):
    rng = np.random.default_rng(channels)
    for height, width in ((1, 1), (7, 5), (11, 1), (2, 9)):
        made = rng.integers(0, 256, size=(height, width, channels)).astype(np.uint8)
        assert np.array_equal(images.png_pixels(fixtures.png(made)), made)
        assert np.array_equal(images.png_pixels(images.png_of(made)), made)


def test_areas_against_single_places():
    rng = np.random.default_rng(1)
    made = rng.integers(0, 256, size=(13, 17, 3))
    got = images.resampled(made, 5, 4)
    fine = np.repeat(np.repeat(made, 4, axis=0), 5, axis=1)  # each old pixel as 4 x 5 places, each new one 13 x 17 of them
    want = fine.reshape(4, 13, 5, 17, 3).sum(axis=(1, 3)) // (13 * 17)
    assert np.array_equal(got, want)


def test_sizes_of_formats(spark):
    jpeg = b"\xff\xd8" + b"\xff\xe0\x00\x04ab" + b"\xff\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 480, 640) + b"\x01\x01\x11\x00"
    files = [(1, fixtures.png(np.zeros((3, 40, 1), np.uint8))), (2, b"GIF89a" + struct.pack("<HH", 7, 9)), (3, jpeg), (4, b"\x89PNG\r\n\x1a\n"), (5, b""), (6, None), (7, b"\xff\xd8\xff")]
    df = spark.createDataFrame(files, "id int, image binary")
    got = {r.id: r.x and tuple(r.x) for r in df.select("id", images.described("image").alias("x")).collect()}
    assert got == {1: ("png", 40, 3), 2: ("gif", 7, 9), 3: ("jpeg", 640, 480), **dict.fromkeys((4, 5, 6, 7), (None, None, None))}
    fit = {r.id: r.y for r in df.select("id", images.fitted(10)("image").alias("y")).collect()}
    assert images.size_of(bytes(fit[1])) == ("png", 10, 1) and bytes(fit[3]) == jpeg and fit[6] is None and bytes(fit[4]) == files[3][1]


def test_image_rows_keep_their_place(spark):
    made = [(1, fixtures.docx(["x"], [b"a", b"", b"c"]), "docx"), (2, fixtures.pptx([["only text"]]), "pptx"), (3, b"PK\x03\x04 broken", "docx"), (4, None, "docx"), (5, b"text", "txt")]
    rows = images.image_rows(spark.createDataFrame(made, "id int, content binary, content_type string"))
    assert sorted((r.id, r.image_idx, bytes(r.image)) for r in rows.collect()) == [(1, 0, b"a"), (1, 1, b""), (1, 2, b"c")]
    said = rows.withColumn("text", F.when(F.length("image") > 0, F.decode("image", "UTF-8")).otherwise(""))
    assert [tuple(r) for r in images.texts_of(said, "id").collect()] == [(1, "[Image 1]\na\n\n[Image 3]\nc")]


@pytest.mark.parametrize("rate", [8000, 11025, 22050, 44100, 48000, 16000])
def test_tones_keep_pitch_and_loudness(rate):
    n = rate // 2
    tone = np.round(8000 * np.sin(2 * np.pi * 440 * np.arange(n) / rate))[:, None].repeat(2, axis=1)
    pcm, was, ms = audio.prepare(fixtures.wav(tone, rate))
    got = np.frombuffer(pcm, "<i2").astype(float)
    assert (was, ms, len(got)) == (rate, n * 1000 // rate, 8000)
    want = 8000 * np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
    assert np.abs(got - want)[400:-400].max() < 80 and np.abs(np.fft.rfft(got)).argmax() == 220


def test_what_is_above_half_the_new_rate_goes():
    high = np.round(8000 * np.sin(2 * np.pi * 15000 * np.arange(24000) / 48000))[:, None]
    assert np.abs(np.frombuffer(audio.prepare(fixtures.wav(high, 48000))[0], "<i2"))[400:-400].max() < 40


def test_widths_and_errors(spark):
    eight = audio.prepare(fixtures.wav(np.array([[128], [255], [0]]), 16000, bits=8))[0]
    assert np.frombuffer(eight, "<i2").tolist() == [0, 127 * 256, -32768]
    form = struct.pack("<HHIIHH", 1, 1, 16000, 48000, 3, 24)
    data = (-(1 << 22)).to_bytes(3, "little", signed=True) + (1 << 21).to_bytes(3, "little")
    wide = b"RIFF\0\0\0\0WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 6) + data
    assert np.frombuffer(audio.prepare(wide)[0], "<i2").tolist() == [-16384, 8192]
    made = [(1, fixtures.wav(np.zeros((16000, 1)), 16000), "a.wav"), (2, fixtures.wav(np.zeros((48000, 1)), 16000), "b.wav"), (3, b"OggS", "c.ogg"), (4, None, None), (5, b"x" * 200_000, "d.wav"), (6, fixtures.wav(np.zeros((0, 1)), 8000), "e.wav"), (7, b"RIFF\0\0\0\0WAVE", "f.wav")]
    df = spark.createDataFrame(made, "id int, content binary, filename string")
    got = {r.id: r for r in audio.recognised(audio.prepared(df, max_bytes=150_000, max_ms=2000), F.octet_length("pcm")).collect()}
    assert (got[1].heard, got[1].duration_ms, got[1].error) == (32000, 1000, None) and (got[6].heard, got[6].duration_ms) == (0, 0)
    assert {k: got[k].error for k in (2, 3, 4, 5, 7)} == {
        2: "AudioTooLongError: Audio exceeds 2s recording limit.", 3: "UnsupportedAudioFormatError: Could not decode audio (.ogg): no RIFF file", 4: "UnsupportedAudioFormatError: Could not decode audio (): no RIFF file",
        5: "AudioTooLongError: Audio upload exceeds 150000 bytes.", 7: "UnsupportedAudioFormatError: Could not decode audio (.wav): no format or no data",
    }
    assert got[2].heard is None and got[2].duration_ms == 3000


@pytest.mark.parametrize("name", ["image_sizes", "speech_inputs"])
def test_work_on_rows_of_a_small_file_is_dealt_over_cores(spark, name):
    made = QUERIES[name](spark, "/root/testdata/sf0.001")
    own = [r[0] for r in made.groupBy(F.spark_partition_id().alias("part")).count().select("count").collect()]
    assert len(own) >= spark.sparkContext.defaultParallelism and max(own) <= 2 * min(own)


def test_an_image_is_fitted_once(spark):
    plan = QUERIES["image_sizes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("fit(") == plan.count("shaded(") == 1, plan


def test_a_recording_above_the_time_tells_its_rate_and_length():
    with pytest.raises(audio.AudioTooLongError) as told:
        audio.prepare(fixtures.wav(np.zeros((4000, 1)), 8000), max_ms=250)
    assert (told.value.rate, told.value.ms) == (8000, 500)


def test_a_resampled_sample_does_not_depend_on_its_block(monkeypatch):
    x = np.random.default_rng(2).normal(size=3000)
    whole = audio.resampled(x, 11025)
    monkeypatch.setattr(audio, "BLOCK", 7)
    assert np.array_equal(whole, audio.resampled(x, 11025))

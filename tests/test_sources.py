import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import signal
from corpusloom.operators.corpus import gaps, stride, stride_merge
from corpusloom.sources import audio
from corpusloom.sources import manifests as M


def test_documents(spark, tmp_path):
    docs = {
        "a.json": {"data": [{"audios": ["x", 3], "task_type": "qa_mc", "mc_options": ["p", "q"]}, "skip", {"audios": None, "mc_options": [{"content": "p", "is_correct": True}]}]},
        "b.json": {"other": []}, "c.json": {"data": 5}, "d.json": [1], "e.json": {"data": []},
    }
    for name, v in docs.items():
        (tmp_path / name).write_text(json.dumps(v))
    (tmp_path / "f.json").write_text("no json")
    df = M.read_train_manifest(spark, str(tmp_path))
    rows = df.orderBy("row_idx").select("doc", "row_idx", "task_type", M.text_items(F.col("audios")).alias("a"), F.schema_of_variant("mc_options").alias("o")).collect()
    assert [(r["row_idx"], r["task_type"], r["a"]) for r in rows] == [(0, "qa_mc", ["x", None]), (2, None, None)]
    assert rows[0]["o"] == "ARRAY<STRING>" and rows[1]["o"].startswith("ARRAY<OBJECT")


def test_document_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "ü\U0001f600"), (0, "a\"b"), (1, "三")], "row_idx long, s string")
    p = tmp_path / "deep" / "out.json"
    M.write_document(df, str(p))
    assert p.read_bytes().isascii() and json.loads(p.read_text()) == {"data": [{"s": "a\"b"}, {"s": "三"}, {"s": "ü\U0001f600"}]}
    assert [json.loads(r[0]) for r in df.orderBy("row_idx").select(M.ascii_json(F.to_json(F.struct("s")))).collect()] == [{"s": "a\"b"}, {"s": "三"}, {"s": "ü\U0001f600"}]
    assert all(r[0].isascii() for r in df.select(M.ascii_json(F.col("s"))).collect())


def test_jsonl(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(20)], "i long, s string")
    M.append_jsonl(df.coalesce(1), str(tmp_path / "o"))
    M.append_jsonl(df.coalesce(1), str(tmp_path / "o"))
    got = M.read_jsonl(spark, str(tmp_path / "o"), "i long, s string")
    assert got.count() == 40 and {(r["line"], r["i"]) for r in got.collect()} == {(i, i) for i in range(20)}
    (tmp_path / "bad").write_text('{"i": 1}\n\n')
    with pytest.raises(Exception, match="blank line"):
        M.read_jsonl(spark, str(tmp_path / "bad"), "i long").collect()


def test_lookup(spark, tmp_path):
    (tmp_path / "map").write_text("a /1\nb\t/2 \na /3\n")
    assert {(r["key"], r["value"]) for r in M.read_lookup(spark, str(tmp_path / "map")).collect()} == {("a", "/3"), ("b", "/2")}
    (tmp_path / "bad").write_text("a b c\n")
    with pytest.raises(Exception, match="not two pieces"):
        M.read_lookup(spark, str(tmp_path / "bad")).collect()


def test_config(tmp_path):
    M.write_config({"model_args": {"a": 1, "b": None, "x": 9}}, str(tmp_path / "config.json"))
    assert M.read_config(str(tmp_path / "weights"), {"a": 0, "b": 2, "c": 3}) == {"a": 1, "b": 2, "c": 3}
    assert M.read_config("/nowhere/at/all", {"a": 0}) == {"a": 0}


def test_parts_merge(spark, tmp_path):
    df = spark.range(103).select(F.col("id").alias("row_idx"), (F.col("id") * 2).alias("v"))
    M.write_parts(df, str(tmp_path / "p"), 4)
    back = M.merge_parts(spark, str(tmp_path / "p"), "row_idx long, v long")
    assert [tuple(r) for r in back.orderBy("row_idx").select("row_idx", "v").collect()] == [(i, 2 * i) for i in range(103)]
    dealt = df.select(stride(F.col("row_idx"), 4).alias("worker"), F.floor(F.col("row_idx") / 4).alias("line"))
    assert gaps(stride_merge(dealt.where("worker <> 2 or line <> 5"), 4), 103).collect() == [(22,)]


def write_wav(path, x, rate=8000, width=2):
    with wave.open(str(path), "w") as w:
        w.setnchannels(len(x))
        w.setsampwidth(width)
        w.setframerate(rate)
        scale = {1: lambda v: struct.pack("B", int(v * 127 + 128)), 2: lambda v: struct.pack("<h", int(v * 32767)), 3: lambda v: struct.pack("<i", int(v * (2**23 - 1)))[:3]}[width]
        w.writeframes(b"".join(scale(v) for f in zip(*x) for v in f))


def test_audio(spark, tmp_path):
    t = np.arange(8000) / 8000
    tone = np.sin(2 * np.pi * 440 * t) * 0.5
    for w in (1, 2, 3):
        write_wav(tmp_path / f"w{w}.wav", [tone, np.zeros(8000)], width=w)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "odd.xyz").write_bytes(b"x")
    rows = {r["path"].rsplit("/", 1)[-1]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert {k: r["ok"] for k, r in rows.items()} == {"w1.wav": True, "w2.wav": True, "w3.wav": True, "bad.wav": False, "odd.xyz": False}
    for w, tol in ((1, 0.02), (2, 1e-3), (3, 1e-3)):
        assert np.abs(np.array(rows[f"w{w}.wav"]["channels"][0]) - tone).max() < tol
    short = {r["path"].rsplit("/", 1)[-1]: r for r in audio.read_audio(spark, str(tmp_path), frames=100).where("ok").collect()}
    assert len(short["w2.wav"]["channels"][0]) == 100
    f = signal.features(audio.read_audio(spark, str(tmp_path)).where("path like '%w2%'"), signal.Plan(chunk_seconds=1)).collect()
    assert [(r["chunk"], r["n_frames"], r["length"], len(r["frames"][0])) for r in f] == [(0, 98, 98, 128)]
    f = signal.features(audio.read_audio(spark, str(tmp_path)).where("path like '%w2%'"), signal.Plan(chunk_seconds=0.8)).collect()
    assert [(r["chunk"], r["n_frames"], r["length"]) for r in f] == [(0, 78, 78), (1, 78, 50)]  # the last holds 0.2 s


def test_signal():
    t = np.arange(8000) / 8000
    x = np.sin(2 * np.pi * 440 * t)
    y = signal.resample(x, 8000, 16000)
    assert len(y) == 16000 and np.abs(y[200:-200] - np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)[200:-200]).max() < 0.01
    assert signal.resample(x, 8000, 8000) is x
    assert signal.downmix(np.array([[1.0, 3.0], [3.0, 5.0]])).tolist() == [2, 4] and signal.downmix(np.array([[1.0], [3.0]]), "first").tolist() == [1]
    assert signal.chunked(np.ones(7), 5).shape == (2, 5) and signal.chunked(np.ones(4), 5).shape == (1, 4) and signal.chunked(np.ones(4), 5, True).shape == (1, 5)
    peak = signal.log_mel(np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)).mean(0).argmax()
    mel = lambda f: 1127 * np.log1p(f / 700)
    assert abs(peak - ((mel(1000) - mel(20)) / (mel(8000) - mel(20)) * 129 - 1)) < 2
    assert signal.log_mel(np.zeros(10)).shape == (0, 128)


def test_mel_spectrogram():
    x = np.sin(2 * np.pi * 3000 * np.arange(24000) / 24000)
    y = signal.mel_spectrogram(x)
    assert y.shape == (101, 128) and y.min() >= np.log(1e-7) - 1e-6
    edges = 700 * np.expm1(np.linspace(0, 1127 * np.log1p(12000 / 700), 130) / 1127)
    assert abs(edges[y[50].argmax() + 1] - 3000) < 150
    bank = signal.mel_filters(128, 960, 24000, 0.0, straight_in="hertz")
    assert bank.shape == (128, 481) and bank.min() >= 0 and bank.max() <= 1 + 1e-9


def test_plans():
    frames, mask = signal.padded_mel(np.ones(1000))
    assert frames.shape == (3000, 128) and mask.sum() == 7 and np.allclose(frames[100:], np.log(1e-7))
    assert len(signal.PLANS) == 10 and [n for _, _, n in signal.prepared([np.ones(1000)], 16000, signal.plan_of("whisper"))] == [1500]
    with pytest.raises(ValueError, match="no encoder"):
        signal.plan_of("nope")
    assert [(k, len(y), n) for k, y, n in signal.prepared([], 16000, signal.Plan("raw"))] == [(0, 0, 0)]


def test_probe(spark):
    rows = [("a.mp3", b"ID3\x04"), ("b.mp3", bytes([255, 251, 144, 0])), ("c.mp3", b"RIFF"), ("d.mp3", b""), ("e.wav", b"")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")
    assert {r["path"]: r["valid"] for r in audio.probe(df).collect()} == {"a.mp3": True, "b.mp3": True, "c.mp3": False, "d.mp3": False, "e.wav": True}

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import signal
from corpusloom.plans import audio as Q
from corpusloom.sources import audio
from test_sources import write_wav


@pytest.fixture(scope="module")
def repeated(data, tmp_path_factory):
    """Entries of which a few are there twice."""
    d = tmp_path_factory.mktemp("repeated")
    t = pq.read_table(f"{data}/audio_inventory.parquet")
    pq.write_table(pa.concat_tables([t, t.slice(0, 5)]), d / "audio_inventory.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["audio_resample", "audio_routed"])
def test_one_pass_over_the_files(spark, repeated, name):
    df = Q.QUERIES[name](spark, repeated)
    assert "Join" not in df._jdf.queryExecution().toString() and "frames:" not in df._jdf.queryExecution().analyzed().toString()
    con = duckdb.connect()
    con.sql(f"create view audio_inventory as select * from '{repeated}/audio_inventory.parquet'")
    rel = con.sql(Q.ORACLE[name])
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)


def test_described_as_features(spark, tmp_path):
    t = np.arange(9000) / 8000
    for k, n in enumerate((0, 1, 200, 399, 1000, 9000)):
        write_wav(tmp_path / f"{k}.wav", [np.sin(2 * np.pi * 440 * t)[:n] * 0.5] * (1 + k % 2), rate=(8000, 44100, 16000)[k % 3])
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    files = audio.read_audio(spark, str(tmp_path))
    plans = [*sorted(signal.PLANS), signal.Plan("raw", rate=24000), signal.Plan(chunk_seconds=0.4), signal.Plan("raw", rate=None, chunk_seconds=0.01, always=True)]
    got = {(r["path"], r["encoder"], r["chunk"]): tuple(r)[3:] for r in signal.described(files, *plans).select("path", F.inline("chunks")).collect()}
    want = {(r["path"], e, r["chunk"]): tuple(r)[2:] for e, p in enumerate(plans) for r in signal.features(files, p).select("path", "chunk", "length", "n_frames", F.size(F.get("frames", F.lit(0))).alias("width")).collect()}
    assert got == want and len({k[0] for k in got}) == 6
    some = signal.described(files, F.when(F.col("path").contains("4.wav"), "mimo")).collect()
    assert sorted(len(r["chunks"]) for r in some) == [0, 0, 0, 0, 0, 1]


def test_resampled_together():
    """As the weights of every output computed anew, whatever stands beside a signal."""
    rng = np.random.default_rng(0)
    for old, new in ((8000, 24000), (44100, 16000), (48000, 16000), (44101, 16000), (11025, 24000)):
        xs = [rng.standard_normal(n) for n in (0, 1, 441, 1000)]
        cut = min(1.0, new / old)
        for x, y in zip(xs, signal.resampled(xs, old, new)):
            assert np.allclose(y, signal._at_once(x, old, new, cut, int(np.ceil(16 / cut))), atol=1e-9)
    odd = np.ones(1000)
    odd[500] = np.nan
    assert np.isnan(signal.resample(odd, 48000, 16000)).sum() <= 33


def test_decoded_files_share_batches(monkeypatch):
    """A batch holds many short files, and one long file at most beyond ``HELD`` samples."""
    seen = {}

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            seen["run"] = run

    monkeypatch.setattr(audio, "HELD", 2500)
    monkeypatch.setitem(audio.DECODERS, "ones", lambda content, frames: (8000, np.ones((1, int(content)))))
    audio.decode(Files())
    sizes = [1000, 1000, 1000, 9000, 10, -1, 10]
    b = pa.RecordBatch.from_arrays([pa.array([f"{i}.ones" for i in range(7)]), pa.array([str(n).encode() for n in sizes])], names=["path", "content"])
    out = list(seen["run"]([b]))
    assert [x.num_rows for x in out] == [3, 1, 3]
    rows = [r for x in out for r in x.to_pylist()]
    assert [r["channels"] and len(r["channels"][0]) for r in rows] == [1000, 1000, 1000, 9000, 10, None, 10] and [r["ok"] for r in rows] == [n > 0 for n in sizes]

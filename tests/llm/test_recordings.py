import random

import pytest

from corpusloom.llm import recordings as R


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("alphabet,k", [("ab", 1), ("0123456789", 1), ("ab", 0), ("ab", 2), ("0123456789", 2), ("01", 3)])
def test_join_is_complete(spark, alphabet, k):
    rng = random.Random(3)
    strings = {"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7))) for _ in range(160)} | {"pre_" + "".join(rng.choice(alphabet) for _ in range(5)) for _ in range(60)}
    strings = sorted(strings)
    left, right = strings[::2], strings[1::3] + strings[::7]
    mk = lambda xs: spark.createDataFrame([("g", x) for x in xs] + [("g", None)], "g string, s string")
    got = {(r["a"], r["b"]): r["distance"] for r in R.edit_segment_join(mk(left), mk(set(right)), k).collect()}
    want = {(a, b): distance(a, b) for a in left for b in set(right) if distance(a, b) <= k}
    assert got == want


def test_groups_and_null_groups_do_not_mix(spark):
    a = spark.createDataFrame([("x", "s1"), (None, "s2")], "g string, s string")
    b = spark.createDataFrame([("y", "s1"), (None, "s3"), ("x", "s1")], "g string, s string")
    assert sorted(tuple(r) for r in R.edit_segment_join(a, b).collect()) == [("", "s2", "s3", 1), ("x", "s1", "s1", 0)]


@pytest.mark.parametrize(
    "a,b,same",
    [
        ("/v/gigavoice/s/audio/GVC2000000060/GVC2000000060_S0000006.wav", "/w//Gigavoice/x/./audio/gvc2000000060/gvc2000000060_s6-copy.mp3", True),
        ("/v/gigavoice/s/audio/GVC2000000060/GVC2000000060_S0000006.wav", "/v/gigavoice/s/audio/GVC2000000060/GVC2000000060_S00000069999.wav", False),
        ("/v/capnook/audio/2v6c4gpv1m6_10.wav", "/x/capnook/audio/Y2v6c4gpv1m6_10_norm.flac", True),
        ("/v/capnook/audio/2v6c4gpv1m6_10.wav", "/v/capnook/audio/2v6c4gpv1m6_0.wav", False),
        ("/v/tunecards/yvedah9ff1e.wav", "/v/tunecards/Yyvedah9ff1e (1).wav", True),
        ("/v/facevoice/wav/id1/xgecfmx7l56/00004.wav", "/z/facevoice/wav/id1/xgecfmx7l56/4.WAV", True),
        ("/v/fieldclips/development/Windy dynamo at Wynitarn 20285.wav", "/v/fieldclips/evaluation/windy%20dynamo%20at%20wynitarn%2020285_16k.wav", True),
        ("/v/wavtrove/harbour_set/100081.flac", "/v/wavtrove/studio_set/100081.flac", False),
        ("/v/pairmix/talehall2mix/min/3000-4_7000-4.wav", "/q/PAIRMIX/talehall2mix/min/3000-4_7000-4~.wav.tmp", True),
        ("/v/shared/room.wav", "/v/./shared//room.wav", True),
        ("/v/shared/room.wav", "/v/shared/Room.wav", False),
    ],
)
def test_identity(a, b, same):
    n = R.Namer(["pairmix", "talehall", "gigavoice", "capnook", "moodbox", "facevoice", "fieldclips", "opentongue", "wavtrove", "tunecards", "chartsong"])
    x, y = n(a), n(b)
    assert (x[2] == y[2]) == same
    if same:
        assert distance(x[1], y[1]) <= R.K


def test_zeros_inside_an_id_count():
    n = R.Namer(["capnook", "tunecards", "gigavoice"])
    assert n("/v/tunecards/ab0cd3fgh1j.wav")[2] != n("/v/tunecards/ab00cd3fgh1.wav")[2]
    assert n("/v/capnook/audio/xri02jjjsu0_010.wav")[1:] == ("xri02jjjsu0_10", "capnook|xri02jjjsu0|10")
    assert n("/v/gigavoice/a/GVC2000000142/GVC2000000142_S0000001.wav")[1] == "gvc2000000142_s1"


ADDED = {
    "talehall": "/v/talehall/TaleHall/train-lit-360/101/10007/101-10007-0033{}.flac",
    "moodbox": "/v/moodbox/Session3/sentences/wav/Mb000007/Mb000007_M017{}.wav",
    "pairmix": "/v/pairmix/talehall2mix/min/3000-4_7000-4{}.wav",
    "chartsong": "/v/chartsong/d/b/TRdbvnwl6k2li{}.mp3",
    "gigavoice": "/v/gigavoice/m_files/audio/GVC2000000137/GVC2000000137_S0000018{}.wav",
    "capnook": "/v/capnook/audio/s6tfd5wyvcf_20{}.wav",
    "tunecards": "/v/tunecards/2stt1xm2gx1{}.wav",
    "facevoice": "/v/facevoice/wav/id10011/iq9lro26ax3/00004{}.wav",
    "fieldclips": "/v/fieldclips/development/Heavy lagoon at Kaserath 20694{}.wav",
    "opentongue": "/v/opentongue/de/clips/ot_de_17000284{}.mp3",
    "wavtrove": "/v/wavtrove/archive_set/100096{}.flac",
}


def test_additions_that_no_list_holds(spark, tmp_path):
    """Additions to a name hide no pair; digits that go on a number or an id name another recording."""
    sources = ["pairmix", *(s for s in ADDED if s != "pairmix")]
    write = lambda name, rows, kind: spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    write("mix_targets", [(s, i) for i, s in enumerate(sources)], "source string, match_rank int")
    write("test_items", [(i, "test", ADDED[s].format("")) for i, s in enumerate(sources)], "item_id long, split string, path string")
    rows = [(100 * k + i, [ADDED[s].format(x)]) for k, x in enumerate(("_part9", " final mix", "-remastered_v2", "9999"), 1) for i, s in enumerate(sources)]
    write("train_samples", rows, "row_idx long, audios array<string>")
    got = {tuple(r) for r in R.p1_found(spark, str(tmp_path)).collect()}
    assert got == {(i, 100 * k + i) for k in (1, 2, 3) for i in range(len(sources))}

import io
import os
import pickle

import numpy as np
import pytest

from tidemark.sources import pickles


def session():
    rng = np.random.default_rng(1)
    return {
        "subject": "S7", "label": np.arange(3000, dtype="i4"), "note": ["free", ("text", 1.5, None, True, 2**70, -3)],
        "signal": {"chest": {"ACC": rng.normal(size=(2500, 3)), "ECG": rng.normal(size=(40, 1)).astype(">f4"), "T": np.asfortranarray(rng.normal(size=(70, 2)))}, "wrist": {"BVP": np.array([1.0, np.nan, 3.0]), "empty": np.zeros((0, 1))}},
    }


@pytest.mark.parametrize("protocol", range(6))
def test_structure_of_every_protocol(protocol):
    own = session()
    data = pickle.dumps(own, protocol)
    found = pickles.structure(io.BytesIO(data), len(data))
    assert pickles._text(found["subject"]) == "S7" and found["note"][0] in ("free",) and found["note"][1][1:] == (1.5, None, True, 2**70, -3)
    arrays = dict(pickles.arrays_of(found))
    assert list(arrays) == ["label", "signal/chest/ACC", "signal/chest/ECG", "signal/chest/T", "signal/wrist/BVP", "signal/wrist/empty"]
    for path, array in arrays.items():
        want = own
        for key in path.split("/"):
            want = want[key]
        for shares in (1, 3):
            parts = [v for k in range(shares) for _, v in pickles.rows_of(io.BytesIO(data), array, k, shares, block=64)]
            got = np.concatenate(parts) if parts else np.zeros((0, 1))
            assert np.array_equal(got.reshape(want.shape), want.astype(float), equal_nan=True)


def test_texts_of_python_2_and_by_hand():
    data = b"\x80\x02}q\x00(U\x07subjectq\x01S'S2'\np2\nU\x01aI01\nU\x01bL7L\nU\x01cF1.5\nU\x01dg2\nu."
    found = pickles.structure(io.BytesIO(data), len(data))
    assert {k: pickles._text(v) for k, v in found.items()} == {"subject": "S2", "a": True, "b": 7, "c": 1.5, "d": "S2"}


class Hostile:
    def __init__(self, what, *arguments):
        self.what, self.arguments = what, arguments

    def __reduce__(self):
        return self.what, self.arguments


@pytest.mark.parametrize("protocol", [0, 2, 4])
@pytest.mark.parametrize("what", [(os.system, "touch /tmp/tidemark-hostile"), (eval, "1"), (__import__, "os"), (np.load, "x"), (getattr, 1, "real")])
def test_a_hostile_file_is_an_error_and_runs_nothing(protocol, what):
    data = pickle.dumps({"subject": "S1", "label": Hostile(*what)}, protocol)
    with pytest.raises(pickles.PickleError, match="names"):
        pickles.structure(io.BytesIO(data), len(data))
    assert not os.path.exists("/tmp/tidemark-hostile")


def test_malformed_files_are_errors():
    data = pickle.dumps(session(), 2)
    for broken in (b"", b".", b"abc", data[:-300], b"(", b"s.", b"}K\x01K\x02K\x03s.", b"\x80\x04\x8c\x02os\x8c\x06system\x93.", b"cnumpy\ndtype\n(tR.", b"h\x07.", b"X\xff\xff\xff\xff", b"B\xff\xff\xff\x7f", b"}}}s.", b"Iabc\n."):
        with pytest.raises(pickles.PickleError):
            pickles.structure(io.BytesIO(broken), len(broken))
    objects = pickle.dumps({"a": np.array([Hostile(eval, "1")], dtype=object)}, 2)
    with pytest.raises(pickles.PickleError):
        pickles.structure(io.BytesIO(objects), len(objects))
    wrong = pickle.dumps(np.zeros(1000), 2).replace(b"M\xe8\x03", b"M\xe9\x03")
    with pytest.raises(pickles.PickleError, match="fit"):
        pickles.structure(io.BytesIO(wrong), len(wrong))


def test_files_are_read_in_shares(spark, tmp_path):
    own = session()
    (tmp_path / "S7.pkl").write_bytes(pickle.dumps(own, 2))
    (tmp_path / "other.pkl").write_bytes(pickle.dumps({"x": np.arange(5)}, 4))
    rows = pickles.read_pickles(spark, str(tmp_path), share_bytes=10_000)
    assert rows.rdd.getNumPartitions() > 5
    got = rows.toPandas()
    acc = got[got.signal == "signal/chest/ACC"].sort_values(["idx", "channel"])
    assert np.array_equal(acc.value.to_numpy().reshape(-1, 3), own["signal"]["chest"]["ACC"]) and set(acc.subject) == {"S7"} and set(got[got.signal == "x"].subject) == {"other"}
    assert got[got.signal == "signal/wrist/BVP"].value.isna().tolist().count(True) == 1 and len(got) == 3000 + 7500 + 40 + 140 + 3 + 5
    samples = pickles.read_sessions(spark, str(tmp_path)).groupBy("modality", "fs").count().collect()
    assert {tuple(r) for r in samples} == {("ECG", 700, 40), ("PPG", 64, 3)}
    (tmp_path / "bad.pkl").write_bytes(pickle.dumps(Hostile(eval, "1")))
    with pytest.raises(Exception, match="names"):
        pickles.read_pickles(spark, str(tmp_path)).count()

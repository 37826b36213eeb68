import struct

import numpy as np
import pytest

from quillvec.sources import binary, files


def rows(loaded):
    return [(r.c1, r.c2, r.c3) for r in loaded.rows.orderBy("row_num").collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'q,a,d\n1,2,3\n"x,1",y,z\np,"q""r",s\na,"b,c\na,b,\nbad,row\n\n1,2,3,4\n5,6,7\r\nlast,one,x')
    got = files.read_csv3(spark, path)
    want = [("1", "2", "3"), ("x,1", "y", "z"), ("p", "qr", "s"), ("a", "b", ""), ("5", "6", "7"), ("last", "one", "x")]
    assert rows(got) == want and got.size() == (6, 3) and got.get(1) == ("x,1", "y", "z")
    assert rows(files.read_csv3(spark, path, compat="legacy")) == want[:-1]
    with pytest.raises(IndexError):
        got.get(6)
    both = got.append(got)
    assert rows(both) == want * 2 and both.get(7) == want[1]
    assert sorted(tuple(r) for r in files.read_csv3_unordered(spark, path).collect()) == sorted(want)


def test_csv_quote_over_a_line_feed(spark, tmp_path):
    assert rows(files.read_csv3(spark, put(tmp_path, "b.csv", 'h,h,h\n"a\nb",c,d\n'))) == []


def test_several_files_keep_their_order(spark, tmp_path):
    for i in range(3):
        put(tmp_path, f"{i}.csv", "a,b,c\n" + "".join(f"{i},{j},x\n" for j in range(50)))
    assert rows(files.read_csv3(spark, str(tmp_path))) == [(str(i), str(j), "x") for i in range(3) for j in range(50)]


N = files.MISSING
JSON = [
    ('{"q":"a","n":1,"d":"t"}\n{"d":"x"}\n["a"]\n{bad\n\n{"q":null,"n":"s","d":{"e":"f"}}\n', [("a", N, "t"), (N, N, "x"), (N, "s", N)], 3),
    ('["p",2]\n["u","v","w"]\n{"a":"b"}\n[]\n', [("p", N, N), ("u", "v", N), (N, N, N)], 2),
    ('{"k":"v"}\n', [("v", N, N)], 1),
    ('{"a":"1","b":"2","c":"3","d":"4"}\n', [("1", "2", "3")], 4),
    ('oops\n{"a":{"in":"x"},"b" : "y"}\n{"b":"z"}', [(N, "y", N), (N, "z", N)], 2),
    ("{}\n", [(N, N, N)], 0),
    ("nothing parses", [], 0),
]


@pytest.mark.parametrize(("text", "want", "columns"), JSON)
def test_jsonl(spark, tmp_path, text, want, columns):
    got = files.read_jsonl3(spark, put(tmp_path, "a.jsonl", text))
    assert rows(got) == want and got.columns == columns


def test_jsonl_scalar(spark, tmp_path):
    with pytest.raises(ValueError):
        files.read_jsonl3(spark, put(tmp_path, "a.jsonl", '"text"\n'))


def test_txt(spark, tmp_path):
    path = put(tmp_path, "a.txt", "one\n\n  \ntwo\r\nthree")
    got = files.read_txt3(spark, path)
    assert rows(got) == [(x, N, N) for x in ("one", "  ", "two\r", "three")] and got.size() == (4, 1)
    assert rows(files.read_txt3(spark, path, compat="legacy"))[-1] == ("three\0", N, N)
    assert files.read_txt3_unordered(spark, path).count() == 4


def test_empty_files(spark, tmp_path):
    path = put(tmp_path, "a.txt", "")
    assert rows(files.read_txt3(spark, path)) == [] and rows(files.read_csv3(spark, path)) == [] and rows(files.read_jsonl3(spark, path)) == []


@pytest.fixture(scope="module")
def sources(spark):
    binary.register(spark)
    return spark


@pytest.mark.parametrize("kind", ["<f2", "<f4", "<f8"])
def test_npy(sources, tmp_path, kind):
    m = np.array([[1.0, -2.0, 2.0**-24], [np.inf, 0.0, 65504.0], [0.5, 0.25, 0.125]]).astype(kind)
    np.save(tmp_path / "m.npy", m)
    got = sources.read.format("npy").option("rowsPerPartition", 2).load(str(tmp_path / "m.npy")).orderBy("token_id").collect()
    assert [r.token_id for r in got] == [0, 1, 2] and np.array_equal([r.vector for r in got], m.astype(np.float32))


def test_npy_half_floats(sources, tmp_path):
    bits = np.array([[0x3C00, 0xC000, 0x0001, 0x7C00, 0x7E00]], np.uint16).view(np.float16)
    np.save(tmp_path / "h.npy", bits)
    v = sources.read.format("npy").load(str(tmp_path / "h.npy")).first().vector
    assert v[:4] == [1.0, -2.0, 2.0**-24, float("inf")] and v[4] != v[4]


def test_npy_errors(tmp_path):
    def bad(name, write):
        path = tmp_path / name
        write(path)
        with pytest.raises((ValueError, SyntaxError, KeyError)):
            binary.npy_header(str(path))

    bad("a", lambda p: p.write_bytes(b"nothing"))
    for i, m in enumerate([np.zeros((2, 2), np.int32), np.zeros(3, np.float16), np.zeros((2, 2), ">f2"), np.asfortranarray(np.ones((2, 3), np.float16))]):
        bad(f"m{i}", lambda p, m=m: np.save(open(p, "wb"), m))  # noqa: SIM115
    np.save(tmp_path / "t.npy", np.ones((4, 4), np.float16))
    bad("cut", lambda p: p.write_bytes((tmp_path / "t.npy").read_bytes()[:-5]))


def test_npy_write(sources, tmp_path):
    df = sources.createDataFrame([(i, [float(i), 0.5]) for i in range(20)], "token_id int, vector array<float>").repartitionByRange(3, "token_id").sortWithinPartitions("token_id")
    df.write.format("npy").mode("overwrite").save(str(tmp_path / "w.npy"))
    assert np.array_equal(np.load(tmp_path / "w.npy"), np.array([[i, 0.5] for i in range(20)], np.float16))


def test_vecbin(sources, tmp_path):
    df = sources.createDataFrame([(i, [float(i), -1.5], f"db/{i}.txt") for i in range(9)], "id int, vector array<float>, file_path string").coalesce(1)
    path = str(tmp_path / "s.bin")
    df.write.format("vecbin").mode("overwrite").save(path)
    data = open(path, "rb").read()  # noqa: SIM115
    assert struct.unpack("<iQ", data[:12]) == (2, 9) and len(data) == 12 + 9 * (4 + 8 + 256)
    got = sources.read.format("vecbin").option("rowsPerPartition", 4).option("dim", 2).load(path).orderBy("id").collect()
    assert [(r.id, r.vector, r.file_path) for r in got] == [(i, [float(i), -1.5], f"db/{i}.txt") for i in range(9)]
    for wrong in (lambda: sources.read.format("vecbin").option("dim", 3).load(path).collect(), lambda: _cut(path)):
        with pytest.raises(Exception):  # noqa: B017
            wrong()


def _cut(path):
    with open(path, "r+b") as f:
        f.truncate(100)
    binary.VecBinReader({"path": path})

"""WARC, exact search, the n-gram join, components and the pipeline."""

import glob
import gzip
import os
import random
import time

import numpy as np
import pytest

import corpus_pipeline
from lexigrade.llm import components, ngram_join, va_topk, warc

PAGES = "page_id long, url string, html string, payload string"


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>", "x"), (2, None, None, "x"), (3, "u", "<p>é</p>", None), (3, "u", "<p>é</p>", None), (None, "u", "z", "x"), (5, "u", "x" * 20_000_000, "x"), (6, "u", "", "x")]
    path = str(tmp_path_factory.mktemp("warc") / "out")
    return warc.write_archives(spark.createDataFrame(rows, PAGES), path)


def test_round_trip(spark, archive):
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to_id, r.payload_digest) for r in warc.read_archives(spark, archive).collect())
    digest = warc.base32_sha1("<p>é</p>".encode())
    assert [g[:4] for g in got] == [
        ("1", 9, "revisit", "<urn:page:3>"), ("2", 0, "revisit", "<urn:page:6>"), ("3", 9, "response", None), ("3", 9, "response", None), ("5", 20_000_000, "response", None), ("6", 0, "response", None), ("None", 1, "response", None),
    ]
    assert got[0][4] == got[2][4] == digest
    with open(next(iter(__import__("glob").glob(archive + "/part-*"))), "rb") as f:
        assert gzip.decompress(f.read())[:8] == b"WARC/1.1"  # any gzip reader takes it


def test_least_bytes_for_a_revisit(spark, tmp_path):
    rows = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", "")], PAGES)
    got = warc.read_archives(spark, warc.write_archives(rows, str(tmp_path / "w"), min_bytes=3)).collect()
    assert [r.record_type for r in got] == ["response"] * 2
    assert warc.read_archives(spark, warc.write_archives(rows.where("false"), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    """Damage at any place loses the record that it hits and no other; all bytes are accounted for."""
    plain = [warc.record_bytes(i, f"http://x/{i}", (f"<p>{i}</p>" * 30).encode(), None, "2024-01-01T00:00:00Z") for i in range(8)]
    parts = [warc.gzip_member(p) for p in plain] if packed else plain
    data = b"".join(parts)
    assert [r["page_id"] for r in warc.salvage(data)] == list(range(8))
    rng = random.Random(0)
    for _ in range(60):
        hit = rng.randrange(8)
        at = sum(map(len, parts[:hit])) + rng.randrange(len(parts[hit]))
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        rows = list(warc.salvage(bytes(bad)))
        ids = [r["page_id"] for r in rows if r["kind"] == "record" and r["page_id"] in range(8)]
        assert set(range(8)) - {hit} <= set(ids)
        assert sum(r["length"] for r in rows) == len(data)
    rows = list(warc.salvage(b"junk" + parts[0] + b"\0" + parts[1][:-9] + parts[2]))
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("gap", None), ("record", 0), ("gap", None), ("record", 2)]
    assert rows[0]["length"] == 4 and list(warc.salvage(b"")) == [] and [r["kind"] for r in warc.salvage(b"xyz")] == ["gap"]


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 99999999999\r\n\r\n", b"WARC/1.0\r\nX", b"\x1f\x8b\x08", b"\x1f\x8b\x08WARC/1.1\r\n"])
def test_salvage_is_linear(junk):
    """4 MB of false starts, between sound records, are passed over within seconds."""
    record = warc.record_bytes(1, "u", b"<p>x</p>" * 30, None, "2024-01-01T00:00:00Z")
    data = record + b"\0" + junk * (4_000_000 // len(junk)) + warc.gzip_member(record)
    began = time.process_time()
    rows = list(warc.salvage(data))
    assert [(r["kind"], r.get("page_id")) for r in rows] == [("record", 1), ("gap", None), ("record", 1)]
    assert time.process_time() - began < 40


def test_files_are_bounded(spark, tmp_path):
    """Files hold as many records as fit."""
    rows = spark.createDataFrame([(i, "u", random.Random(i).randbytes(3000).hex(), "x") for i in range(40)], PAGES).coalesce(1)
    path = warc.write_archives(rows, str(tmp_path / "w"), file_bytes=20_000)
    sizes = [os.path.getsize(f) for f in glob.glob(path + "/part-*")]
    assert len(sizes) > 5 and max(sizes) <= 20_000 and warc.read_archives(spark, path).where("kind = 'record'").count() == 40


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("split", ["3000", "20000", "1000000"])
def test_long_files_in_ranges(spark, tmp_path, monkeypatch, packed, split):
    """The same rows as of the file as one value, for members that cross ranges, hold false starts, are long, and for damage."""
    rng = random.Random(11)
    bodies = [rng.randbytes(rng.randint(0, 4000)) for _ in range(30)] + [b"\x1f\x8b\x08 WARC/1.0\r\nWARC/".join(rng.randbytes(700) for _ in range(60))] + [rng.randbytes(2500) for _ in range(12)]
    plain = [warc.record_bytes(i, f"http://x/{i}", b, None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    parts = [warc.gzip_member(p) for p in plain] if packed else plain
    parts[20] = parts[20][:-900] + b"\7" * 900
    parts.insert(8, b"garbage " * 900)
    parts.append(parts[0][:-30])
    data = b"".join(parts)
    name = "a.warc.gz" if packed else "a.warc"
    (tmp_path / name).write_bytes(data)
    (tmp_path / f"empty-{name}").write_bytes(b"")
    keys = lambda rows: sorted((r["kind"], r["offset"], r["length"], r["record_id"] or "", bytes(r["payload"] or b"")) for r in rows)
    want = [{"record_id": None, "payload": None} | r for r in warc.salvage(data)]
    monkeypatch.setattr(warc, "READ_BYTES", len(data) - 1)
    monkeypatch.setattr(warc, "RANGE_BYTES", int(split))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read_archives(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    records = lambda rows: [k for k in keys(rows) if k[0] == "record"]
    assert records(r.asDict() for r in got) == records(want)
    covered = sum(r.length for r in got)
    assert covered == sum(r["length"] for r in want) and {r.file.split("/")[-1] for r in got} == {name}


def test_long_gzip_names():
    """A member's name and comment may have any length; false starts whose names lead nowhere cost one look."""
    record = warc.record_bytes(1, "http://x/", b"body", None, "2024-01-01T00:00:00Z")
    plain = warc.gzip_member(record)
    for name in (b"n" * 5000, b"n" * 3_000_000):
        named = plain[:3] + bytes([8 | 16]) + plain[4:10] + name + b"\0" + name[:70_000] + b"\0" + plain[10:]
        rows = list(warc.salvage(plain + named + plain))
        assert [(r["kind"], r["page_id"]) for r in rows] == [("record", 1)] * 3 and sum(r["length"] for r in rows) == 2 * len(plain) + len(named)
    began = time.perf_counter()
    false = (plain[:3] + b"\x08" + b"\1" * 20) * 20_000
    rows = list(warc.salvage(false + plain))
    assert [r["kind"] for r in rows] == ["gap", "record"] and time.perf_counter() - began < 20


def test_salvage_of_other_archives():
    """Whole-file gzip, damage within it, other digests, and HTTP lengths that are not the payload's."""
    plain = [warc.record_bytes(i, f"http://x/{i}", random.Random(i).randbytes(3000), None, "2024-01-01T00:00:00Z") for i in range(8)]
    whole = gzip.compress(b"".join(plain), mtime=0)
    rows = list(warc.salvage(whole + warc.gzip_member(plain[0])))
    assert [(r["kind"], r["page_id"]) for r in rows] == [("record", i) for i in [*range(8), 0]]
    assert sum(r["length"] for r in rows) == len(whole) + len(warc.gzip_member(plain[0]))
    torn = gzip.compress(plain[0] + plain[1][:-500] + b"".join(plain[2:]), mtime=0)
    assert [(r["kind"], r.get("page_id")) for r in warc.salvage(torn)] == [("record", 0), ("gap", None), *(("record", i) for i in range(2, 8))]
    for bad in (whole[: len(whole) // 2], whole[:-8] + b"\0" * 8):
        rows = list(warc.salvage(bad))
        assert [r["page_id"] for r in rows if r["kind"] == "record"] == list(range(3 if len(bad) < len(whole) else 8))
        assert rows[-1]["kind"] == "gap" and sum(r["length"] for r in rows) == len(bad)

    def record(digest, told, body=b"<p>x</p>"):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % told + body
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: {digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    md5 = __import__("hashlib").md5(b"<p>x</p>").hexdigest()
    for digest in (f"md5:{md5}", f"sha1:{warc.base32_sha1(b'<p>x</p>')}", "blake3:abc"):
        (row,) = warc.salvage(record(digest, 8))
        assert (row["kind"], row["payload"], row["reason"]) == ("record", b"<p>x</p>", None)
    (row,) = warc.salvage(record(f"md5:{md5}", 500))
    assert (row["kind"], row["payload_bytes"]) == ("record", 8) and "500" in row["reason"]
    assert [r["kind"] for r in warc.salvage(record("md5:" + "0" * 32, 8))] == ["gap"]


# ---------------------------------------------------------------- 4


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)) / 3
    base[100:200] = base[100]  # a third are one vector
    rows = [(i, [float(x) for x in v], "b") for i, v in enumerate(base)]
    rows += [(900, None, "b"), (901, [None] * 8, "b"), (902, [float("nan")] * 8, "b"), (903, [float("inf")] * 8, "b"), (904, [1.0] * 3, "b"), (905, [0.5] * 3, "b"), (None, [1.0] * 8, "b"), (907, [], "b"), (7, [0.1] * 8, "b"), (908, [30000.5] * 8, "b")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    asked = table.where("vec_id % 20 = 0 OR vec_id IN (904, 7)")
    ints = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    for block in (1 << 24, 300):  # bytes: one block of queries, and many
        monkeypatch.setattr(va_topk, "BLOCK_BYTES", block)
        got: dict = {}
        for r in va_topk.top_k(table, asked, k=20).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q, v in ints:
            if (q % 20 == 0 or q == 904) and q != 7:
                best = sorted(((-int(v @ w), j) for j, w in ints if j != q and len(w) == len(v)))[:20]
                assert sorted(got.get(q, [])) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert va_topk.top_k(table.where("false"), asked.where("false")).count() == 0


def test_top_k_of_large_vectors(spark, monkeypatch):
    """Finite vectors of any size take part, exactly; a result beyond a long is an error."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 4))
    base[:60] *= 10.0 ** rng.integers(0, 7, (60, 1))
    base[40:50] = base[40]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(200, [5e6, 0.0, 0.0, 0.0]), (201, [1e8, 1e8, 0.0, 0.0]), (202, [1.0, -1.0, 0.0, 0.0]), (203, [-1e17, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    asked = [0, 20, 40, 60, 80, 100, 200, 201, 202]
    for block in (1 << 24, 100):
        monkeypatch.setattr(va_topk, "BLOCK_BYTES", block)
        got: dict = {}
        for r in va_topk.top_k(table.where("vec_id <> 203"), table.where(f"vec_id IN ({', '.join(map(str, asked))})"), k=10).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in asked:
            best = sorted((-sum(a * b for a, b in zip(exact[q], exact[j], strict=True)), j) for j in exact if j not in (q, 203))[:10]
            assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    far = table.where("vec_id IN (200, 202, 203)")
    one = far.where("vec_id = 200")
    assert [tuple(r) for r in va_topk.top_k(far, one, k=1).collect()] == [(200, 1, 202, 5 * 64**2 * 10**6)]
    with pytest.raises(Exception, match="beyond a long"):
        va_topk.top_k(far, one, k=2).collect()


def test_top_k_of_vectors_beyond_longs(spark, monkeypatch):
    """Components of any finite size: they are ranked where their scores are, and only a result beyond a long is an error."""
    small = [(i, [0.0, i / 7, -i / 3]) for i in range(60)]
    huge = [(200, [1e18, 0.0, 0.0]), (220, [-1e30, 0.0, 0.0]), (201, [1.7e308, 0.0, 0.0]), (203, [2.0**52 + 0.5, 0.0, 0.0]), (205, [-(2.0**46) - 1 / 64, 0.5, 0.0]), (206, [0.0, 5e-324, -5e-324])]
    rows = small + huge
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [64 * a // b for a, b in (x.as_integer_ratio() for x in v)] for i, v in rows}
    for block in (1 << 24, 50):
        monkeypatch.setattr(va_topk, "BLOCK_BYTES", block)
        got: dict = {}
        for r in va_topk.top_k(table.where("vec_id < 60 OR vec_id IN (200, 205, 206)"), table.where("vec_id IN (20, 40)"), k=70).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in (20, 40):
            best = sorted((-sum(a * b for a, b in zip(exact[q], exact[j], strict=True)), j) for j in exact if j != q and j in (*range(60), 200, 205, 206))
            assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    # 200 meets 205 far below a long, and all others at 0: the first 60 are certain, the last is an error.
    first = va_topk.top_k(table.where("vec_id < 60 OR vec_id IN (200, 205, 206)"), table.where("vec_id = 200"), k=61).collect()
    assert [(r.vec_id, r.score) for r in first] == [(j, 0) for j in (*range(60), 206)]
    for top, ask in (("vec_id IN (200, 205)", "vec_id = 200"), ("vec_id IN (200, 201)", "vec_id = 200"), ("vec_id IN (220, 201, 1)", "vec_id = 220")):
        with pytest.raises(Exception, match="beyond a long"):
            va_topk.top_k(table.where(top), table.where(ask), k=5).collect()
    assert [tuple(r) for r in va_topk.top_k(table.where("vec_id IN (200, 1, 2, 40)"), table.where("vec_id = 40"), k=1).collect()] == [(40, 1, 2, sum(a * b for a, b in zip(exact[40], exact[2])))]
    assert va_topk.integer(0.5) == 1 << 63 and va_topk.integer(-1.5 * 2.0**-64) == -2 and va_topk.integer(1.5) == 3 << 63



def test_top_k_of_repeated_queries(spark, monkeypatch):
    """Every query row has its own ranking, equal copies and other vectors of one id alike."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 4))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(20, rows_of.tolist()) for rows_of in (base[20], base[20], -base[20], 1e7 * base[20])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for q, v in ints:
        if q % 20 == 0:
            best = sorted((-int(v @ w), j) for j, w in ints if j != q)[:5]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    for block in (1 << 24, 100):
        monkeypatch.setattr(va_topk, "BLOCK_BYTES", block)
        got = va_topk.top_k(table, table.where("vec_id % 20 = 0"), k=5).collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert len(want) == 7 * 5


def test_top_k_of_long_vectors(spark):
    """512 components whose products might add up beyond 2**63, and a component of 5e6: scores are those of Python's integers."""
    rng = np.random.default_rng(6)
    base = (rng.integers(-(1 << 28), 1 << 28, (60, 512)) / 64).tolist()
    base[2], base[3] = [5e6] * 4 + [0.0] * 508, [-5e6] + [0.0] * 511
    table = spark.createDataFrame(list(enumerate(base)), "vec_id long, embedding array<double>")
    exact = [[int(np.floor(64 * x)) for x in v] for v in base]
    got: dict = {}
    for r in va_topk.top_k(table, table.where("vec_id IN (0, 2, 20)"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in (0, 2, 20):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[j], strict=True)), j) for j in range(60) if j != q)[:5]
        assert sorted(got[q]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


def test_top_k_with_copies(spark):
    """A vector that a third of all ids hold, ids given many times, and lengths without marks."""
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(100)] + [(i, [2.0, 2.0, 2.0, 2.0]) for i in range(200, 260)]
    rows += [(200, [2.0, 2.0, 2.0, 2.0])] * 30 + [(300, [float(x) for x in range(n)]) for n in range(5, 90)] + [(340, [1.0] * 5), (360, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = [(i, np.floor(64 * np.array(v)).astype(np.int64)) for i, v in rows]
    want = []
    for q, v in ints:
        if q in (20, 220, 200, 340):
            best = sorted((-int(v @ w), j) for j, w in ints if j != q and len(w) == len(v))[:7]
            want += [(q, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    got = va_topk.top_k(table, table.where("vec_id IN (20, 200, 220, 340)"), k=7).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    classes = va_topk.distinct_vectors(va_topk.usable(table, "vec_id", "embedding"), 7)
    assert classes.selectExpr("max(size(ids))").first()[0] == 8


def test_bounds_hold():
    rng = np.random.default_rng(3)
    block, queries = rng.integers(-60, 60, (2000, 16)), rng.integers(-60, 60, (20, 16))
    marks = np.quantile(block[:50], np.arange(1, 32) / 32, axis=0, method="nearest").astype(np.int64)
    edges = (marks, np.vstack([block.min(axis=0), marks]), np.vstack([marks - 1, block.max(axis=0)]))
    scan = va_topk.Scan(np.arange(20), np.arange(20), queries, edges, 5)
    none = np.zeros(2000, np.int64)
    scan.meet(np.arange(2000), none, none.astype(bool), va_topk.approximate(block, marks))
    got = scan.flush()
    exact = queries @ block.T
    for q, c, lower, upper in zip(*(x.to_pylist() for x in got.columns), strict=True):
        assert lower <= exact[q, c] <= upper
    left = {(q, c) for q, c in zip(got["qkey"].to_pylist(), got["cid"].to_pylist(), strict=True)}
    assert all((q, c) in left for q in range(20) for c in np.argsort(-exact[q], kind="stable")[:5])
    assert len(left) < 0.1 * exact.size  # bounds pass most vectors over


# ---------------------------------------------------------------- 5


def brute_components(texts):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [len(s) for s in sets], [root(i) for i in range(len(texts))]


def near_texts(seed, n):
    """Copies, chains of edits, shared passages, short texts and texts without words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(55)]
    bases = [[word() for _ in range(rng.choice([6, 30, 120]))] for _ in range(6)]
    out = [None, "", " \n ", "one two", "ONE two", "a b c d", "a b c d e", "É b c d e", "é b c d e"]
    while len(out) < n:
        kind = rng.random()
        w = list(rng.choice(bases))
        if kind < 0.5:
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = word()
        elif kind < 0.8:
            w = [word() for _ in range(rng.randint(5, 150))] + passage
        else:
            w = w[: rng.randint(1, len(w))]
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("limits", [{}, {"NARROW": 1, "LEADER": 3, "SALT": 20, "TILE": 7}])
def test_ngram_join_brute_force(spark, monkeypatch, seed, limits):
    """Tight limits force salts, wide bands and tiles."""
    for name, value in limits.items():
        monkeypatch.setattr(ngram_join, name, value)
    texts = near_texts(seed, 160)
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")
    got = {r.id: (r.n_shingles, r.component) for r in ngram_join.join(rows).collect()}
    sizes, comps = brute_components(texts)
    assert got == {i: (sizes[i], comps[i]) for i in range(len(texts))}
    kept = sorted(r.doc_id for r in ngram_join.representatives(rows).collect())
    assert kept == sorted(set(comps))


def test_ngram_join_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, ""), (4, ""), (None, None), (2, "other words are in this one")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((str(r.id), r.n_shingles, str(r.component)) for r in ngram_join.join(table).collect()) == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "2"), ("4", 0, "4"), ("4", 0, "4"), ("None", 0, "None"), ("None", 2, "1")]
    assert sorted(str(r.doc_id) for r in ngram_join.representatives(table).collect()) == ["1", "2", "4", "4", "None"]
    assert ngram_join.join(table.where("false")).count() == 0


def test_prefix_and_bitmaps():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 80)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], rng.integers(0, 1 << 62, rng.integers(0, 30)).astype(np.uint64)]))
        both, size = len(np.intersect1d(a, b)), min(len(ngram_join.bitmap(a)), len(ngram_join.bitmap(b)))
        x, y = (ngram_join.folded(ngram_join.bitmap(s), size) for s in (a, b))
        assert both <= (len(a) + len(b) - int(np.bitwise_count(x ^ y).sum())) // 2
        assert ngram_join.linked(a, b) == (5 * both >= 4 * (len(a) + len(b) - both)) == (both >= ngram_join.least_overlap(len(a), len(b)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want: dict = {}
    for a, b in edges:
        if a != b:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                for k in y:
                    want[k] = x
    assert got == {k: min(v) for k, v in want.items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.written(out, "test")
        assert {r.doc_id for r in docs.collect()} <= ids
    _, comps = brute_components([r.text for r in docs.select("doc_id", "text").distinct().collect()])
    assert len(set(comps)) == len(comps)  # no near copies are left
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert final.count() == docs.count() == corpus_pipeline.run(spark, sf).count()


def test_pipeline_stages_take_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    odd = spark.createDataFrame([(1, None, None, None, None, "s"), (None, "", "en", "a", 0, "s"), (3, "some words that are here now", "en", "a", 28, "s"), (3, "some words that are here now", "en", "a", 28, "s")], schema)
    for table in (odd, odd.where("false")):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()
            if "lang" in docs.columns:
                assert docs.columns == table.columns

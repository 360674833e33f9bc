"""Narrations, single paths, score ranges and raw files on planted and odd rows, against plain versions."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import narration as NA
from tracewell.operators import paths as PA
from tracewell.sources import raw_file as RF


def tx_of(spark, texts):
    rows = [(i, f"TXN{i:03d}", i % 3, t, i % 2 == 0, i % 4 == 0, i % 5 == 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "tx_key long, tx_id string, src long, narration string, is_layering boolean, is_headless boolean, is_foreign_ip boolean")


TEXTS = ["UPI/A/b#12", "UPI/A/b_1", "NEFT/A/b", "UPI//b#1", "", "  ", None, "free text", "UPI/A/b#12\n", "RTGS/A/b_2", "UPI/P2P_CRYPTO/Cash#002"]


def test_shapes(spark):
    got = {r.shape: r.n for r in NA.shapes(tx_of(spark, TEXTS)).collect()}
    assert got == {"hash": 2, "underscore": 1, "three_parts": 3, "other": 2, "empty": 3}


def test_words_overlap_and_absent_ones_are_zero(spark):
    got = {r.word: (r.n, r.n_layering) for r in NA.words(tx_of(spark, TEXTS), [*NA.KEYWORDS, "b#1"]).collect()}
    assert got["p2p"] == got["crypto"] == got["cash"] == (1, 1) and got["mule"] == (0, 0) and got["b#1"] == (3, 2) and len(got) == len(NA.KEYWORDS) + 1
    assert {r.n for r in NA.words(tx_of(spark, TEXTS).limit(0), NA.INJECTION_SIGNS).collect()} == {0}
    signs = ["a {{b}}", "x' OR 1=1", "<SCRIPT>", "drop it -- now;", "${y}"]
    assert {r.word: r.n for r in NA.words(tx_of(spark, signs), NA.INJECTION_SIGNS).collect()} == {"{{": 1, "${": 1, "<script": 1, "</": 0, "' or": 1, "drop": 1, "--": 1, ";": 1}


def test_characters_and_references(spark):
    r = NA.characters(tx_of(spark, ["a", "b" * 201, "café", "z​w", None])).first()
    assert (r.shortest, r.longest, r.n_long, r.n_non_ascii, r.n_zero_width) == (1, 201, 1, 2, 1)
    r = NA.references(tx_of(spark, ["x#001", "x_001", "y#001", "none", None, "z#5", "w#77\n"])).first()
    assert tuple(r) == (4, 2, 1, 1, 3)  # the second transfer is TXN001
    assert tuple(NA.references(tx_of(spark, TEXTS).limit(0)).first()) == (0, 0, 0, 0, 0)


def test_account_tokens(spark):
    rows = [("pay SBIN00000001 for HDFC00000002", "SBIN00000001", "HDFC00000002"), ("SBIN00000001SBIN00000009", "HDFC00000002", "X"), (None, "A", "B"), ("sbin00000001", "A", "B")]
    tx = spark.createDataFrame(rows, "narration string, src_no string, dst_no string")
    got = sorted(tuple(r) for r in NA.account_tokens(tx, spark.createDataFrame([("SBIN00000001",), ("SBIN00000001",)], "acct_no string")).select("token", "n", "n_decoys", "is_known").collect())
    assert got == [("HDFC00000002", 1, 0, False), ("SBIN00000001", 2, 1, True), ("SBIN00000009", 1, 1, False)]


def test_greedy_paths_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(12), rng.randrange(12), rng.randint(1, 40), rng.randrange(8000), rng.random() < 0.2) for i in range(250)]
    tx = spark.createDataFrame(rows, "tx_key long, src long, dst long, amount_paise long, ts_sec long, is_layering boolean")
    ends = spark.createDataFrame([(3,), (7,)], "acct long")
    payers = tx.filter("src = 0")
    got = sorted((r.start, r.hop, r.tx_key, r.lag_s) for r in PA.greedy_paths(tx, payers, ends, (0, 900)).collect())
    layers = {r[1] for r in rows if r[5]}
    want = []
    for r in rows:
        if r[1] == 0:
            at, met, want = r, {r[1], r[2]}, [*want, (r[0], 1, r[0], None)]
            for hop in (2, 3, 4):
                near = [n for n in rows if n[1] == at[2] and 0 <= n[4] - at[4] <= 900 and n[2] not in met]
                if not near:
                    break
                best = max(near, key=lambda n: (n[2] in layers, n[2] in (3, 7), n[3], -n[0]))
                want.append((r[0], hop, best[0], best[4] - at[4]))
                at, met = best, met | {best[2]}
    assert got == sorted(want) and max(w[1] for w in want) == 4
    assert PA.greedy_paths(tx, payers.limit(0), ends).count() == 0


def test_score_ranges(spark):
    rows = spark.createDataFrame([("a", 1.0, False), ("a", 5.0, True), ("b", 5.0, True), ("b", 9.0, False), ("c", 6.0, False), ("d", 20.0, True), ("e", None, None)], "grp string, x double, is_flagged boolean")
    got = sorted(tuple(r) for r in PA.overlaps(rows, "grp", "x").select("a", "b", "low", "high", "n_a", "n_b").collect())
    assert got == [("a", "b", 5.0, 5.0, 1, 1), ("b", "c", 6.0, 6.0, 0, 1)]
    stats = {r.grp: r for r in PA.spread(rows, "grp", "x", 5.0, 1.0).collect()}
    assert (stats["a"].q1, stats["a"].n_near_flagged, stats["c"].n_near_not_flagged, stats["e"].n, stats["e"].n_scored) == (2.0, 1, 1, 1, 0)
    assert PA.overlaps(rows.limit(0), "grp", "x").count() == 0


HEADER = ["id", "text", "note"]


def bytewise(files):
    """The counts of `check`, byte by byte over whole files."""
    out = dict.fromkeys(("n_files", "n_bytes", "n_marked", "n_open_ends", "n_lines", "n_crlf", "n_lf", "n_lone_cr", "n_quotes", "n_non_ascii", "n_control", "n_invalid", "n_records", "n_wrong_fields", "n_wrong_headers"), 0)
    seen = {}
    for b in files:
        lines = b.split(b"\n")
        open_end = bool(lines[-1])
        lines = lines if open_end else lines[:-1]
        out["n_files"] += 1
        out["n_bytes"] += len(b)
        out["n_marked"] += b.startswith(b"\xef\xbb\xbf")
        out["n_open_ends"] += open_end
        out["n_lines"] += len(lines)
        crlf = b.count(b"\r\n")
        out["n_crlf"] += crlf
        out["n_lf"] += b.count(b"\n") - crlf
        out["n_lone_cr"] += b.count(b"\r") - crlf
        out["n_quotes"] += b.count(b'"')
        out["n_non_ascii"] += sum(c > 127 for c in b)
        out["n_control"] += sum(c < 32 and c not in (9, 10, 13) or c == 127 for c in b)
        for line in lines:
            try:
                line.decode()
            except UnicodeDecodeError:
                out["n_invalid"] += 1
        records, fields, inside, at = [], 1, False, bytearray()
        for c in b:
            if c == 10 and not inside:
                records.append((bytes(at), fields))
                fields, at = 1, bytearray()
                continue
            inside ^= c == 34
            fields += c == 44 and not inside
            at.append(c)
        if at:
            records.append((bytes(at), fields))
        out["n_wrong_headers"] += records[0][0].removeprefix(b"\xef\xbb\xbf").removesuffix(b"\r") != ",".join(HEADER).encode()
        for r, n in records[1:]:
            out["n_records"] += 1
            out["n_wrong_fields"] += n != len(HEADER)
            r = r.removesuffix(b"\r")
            seen[r] = seen.get(r, 0) + 1
    return out | {"n_repeated": sum(n > 1 for n in seen.values()), "n_in_repeats": sum(n for n in seen.values() if n > 1)}


@pytest.mark.parametrize("size", ["128m", "700b"])
def test_raw_files_byte_for_byte(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(RF, "SLOT", 7)
    rng = random.Random(6)
    head = ",".join(HEADER).encode()
    body = []
    for i in range(300):
        text = rng.choice(["plain", 'with "quotes", and commas', "two\nlines", "café", "a\r\nb", "", "same"])
        body.append(b",".join(b'"' + x.replace('"', '""').encode() + b'"' if rng.random() < 0.5 or set(x) & set('",\n\r') else x.encode() for x in (str(i % 40), text, "n")))
    files = [
        b"\xef\xbb\xbf" + head + b"\r\n" + b"\r\n".join(body[:100]) + b"\r\n",
        head + b"\n" + b"\n".join(body[100:250]),
        b"id,text , note\n" + b"\n".join(body[250:]) + b"\n1,2\n1,2,3,4\n5,\xff\xfe,\x00\x07\x7f\r6\n\n\n" + b'9,"open\nto the end,x\r',
    ]
    for i, b in enumerate(files):
        (tmp_path / f"f{i}.csv").write_bytes(b)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got = RF.check(spark, str(tmp_path), 3, HEADER).first().asDict()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == bytewise(files)


def test_a_plain_file_agrees_with_a_parser(spark, tmp_path):
    path = tmp_path / "f.csv"
    with path.open("w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([HEADER, *([i, f'x,"{i}"\n', "é"] for i in range(50))])
    r = RF.check(spark, str(path), 3, HEADER).first()
    with path.open(newline="") as f:
        assert r.n_records == len(list(csv.reader(f))) - 1 == 50
    assert (r.n_wrong_fields, r.n_wrong_headers, r.n_lines, r.n_repeated) == (0, 0, 101, 0)
    (tmp_path / "none.csv").write_text("")
    assert RF.check(spark, str(tmp_path / "none.csv"), 3, HEADER).first().n_records == 0

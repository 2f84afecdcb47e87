import hashlib
import random
import re

from ledgerloom.llm.automata import Automaton
from ledgerloom.llm.secret_scan import base_spans, find_secrets, op4_secret_scans, redact

RULES = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
)


def plain(text):
    return sorted((m.start(), i, m.end()) for i, (_, p, g, n) in enumerate(RULES) for m in re.finditer(p, text) if len(m[g]) >= n)


def joined(spans):
    return ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in spans)


ODD = ["", None, "Token=abcdefgh", "ſecret = abcdefgh1", "toKen = abcdefgh1", "TOKEN\" : 'x.y-z/+=_", "é🎉 password: short passwd:longenough1 " + "ab" * 20, "AKIAABCDEFGHIJKL AKIA123", "token = token = abcdefgh", "0" * 31 + " " + "0" * 32 + "g" + "f" * 5000, "apikey:api_key=aaaaaaaa"]


def test_base_patterns():
    for text in ODD:
        assert [(s, k, e) for s, k, e, _ in base_spans(text or "")] == plain(text or "")


def test_whole_table(spark):
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    rows = op4_secret_scans(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in want) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert {*joined(want).split(",")} <= {*r.spans.split(",")} or not want


def secrets(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(n)], ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)) for _ in range(n)], rng


def test_formats_are_learned(spark):
    hexes, keys, rng = secrets(60)
    rows = [(i, f"words token = {h} and {k} here") for i, (h, k) in enumerate(zip(hexes, keys))]
    hidden = "".join(rng.choice("0123456789abcdef") for _ in range(28))
    rows += [(100, f"see {hidden} there"), (101, "thtioningerehebleandthes internationalization www.example.com/path/to/page ================")] + [(200 + i, None) for i in range(3)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert got[100].spans == f"format:4:{4 + len(hidden)}" and got[100].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[101].spans == "" and got[200].spans == ""
    clean = {r.doc_id: r for r in redact(docs).collect()}
    assert clean[100].text == "see [REDACTED] there" and clean[100].n_chars == len(clean[100].text) and clean[100].spans == "x"
    assert clean[101].text == rows[61][1] and clean[200].text is None
    assert clean[0].text == "words [REDACTED] and [REDACTED] here"


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] * 2, "doc_id long, text string")
    rows = find_secrets(docs).collect()
    assert len(rows) == 2 * len(ODD)
    for r in rows:
        assert r.spans == joined(plain(ODD[r.doc_id] or ""))
    assert find_secrets(docs.limit(0)).count() == 0


def test_automaton_keeps_prefixes_and_merges_the_rest():
    _, keys, rng = secrets(200)
    a = Automaton(keys)
    assert len(a.step) < 60
    assert sum(sum(t.values()) + e for t, e in zip(a.taken, a.end)) == sum(a.seen)
    other = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20))
    assert a.score(secrets(5, 9)[1][0]) > a.score(other) + 2


def test_automata_know_lengths_and_prefixes():
    hexes, keys, rng = secrets(11)
    fixed = Automaton(hexes)
    assert len(fixed.step) == 41 and fixed.end[-1] == 11 and sum(fixed.end) == 11
    assert fixed.score(hexes[0]) > fixed.score(hexes[0][:30]) and fixed.score(hexes[0]) > fixed.score(hexes[0] * 2)
    free = Automaton(["ab" * n for n in range(1, 60)])
    assert len(free.step) < 12 and free.score("ab" * 300) > free.score("ba" * 300) + 1
    mixed = Automaton([f"sk_{h[:12]}" for h in secrets(80)[0]] + secrets(80)[1])
    assert mixed.score("sk_" + hexes[0][:12]) > mixed.score("AKI" + hexes[0][:12]) and len(mixed.step) > 20
    long = Automaton([*hexes, "x" * 50_000])
    assert len(long.step) < 200


def test_planted_credentials_are_told_from_card_numbers(spark):
    """Unlabelled hex credentials of other lengths against card numbers and words, among the credentials of a whole table."""
    rng = random.Random(5)
    planted = {i: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((20, 24, 28, 31)))) for i in range(100)}
    cards = {1000 + i: "4" + "".join(rng.choice("0123456789") for _ in range(15)) for i in range(100)}
    rows = [(-1 - i, f"see {v} there", "x", "y", 1) for i, v in (planted | cards).items()]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    got = find_secrets(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string, a string, b string, c int").select("doc_id", "text"))).filter("n_format > 0").collect()
    found = {-1 - r.doc_id for r in got}
    assert len(found & planted.keys()) >= 90 and not found & cards.keys()
    assert sum(r.doc_id >= 0 for r in got) <= 3  # the table has no unlabelled credentials


def test_short_formats(spark):
    """A format of twelve characters is learned and found; words and numbers of that length stay."""
    rng = random.Random(8)
    make = lambda: "zk" + "".join(rng.choice("0123456789") for _ in range(5)) + "".join(rng.choice("QRSTVW") for _ in range(5))
    rows = [(-1 - i, f"api_key = {make()} here") for i in range(200)] + [(-1001 - i, f"see {make()} there") for i in range(100)]
    rows += [(-2001 - i, f"{rng.choice(('zookeeper', 'quartz-watch', 'zk-workgroup'))} {rng.randrange(10**11, 10**12)} {rng.randrange(10**7, 10**8)}/2024") for i in range(200)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {r.doc_id for r in find_secrets(docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).filter("n_format > 0").collect()}
    assert sum(-1101 < i <= -1001 for i in got) >= 80
    assert sum(i <= -2001 for i in got) == 0 and sum(i >= 0 for i in got) <= 3

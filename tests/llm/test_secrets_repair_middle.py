"""Secret scans, conversation repair and fill-in-the-middle against plain Python, with nulls, empty tables, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pairlens.llm import middle, queries, repair
from pairlens.llm.secrets import base_spans, find_secrets, shown
from pyspark.sql import functions as F

MORE = "digest string, pieces long, kind string, n long, form string"
DOCS = "doc_id long, text string, " + MORE


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Secret scans

PATTERNS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ("identifier", r"[A-Z]{4}[A-Z0-9]{12,}", lambda m: re.search("[0-9]", m[0])),
    ("key", r"[A-Za-z0-9+/_=-]{32,}", lambda m: all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))),
    ("endpoint", r"""[a-z][a-z0-9+]{1,20}://[^\x20\x09-\x0D"'<>]{4,}""", lambda m: True),
]
SECRET, IDENTIFIER = (0, 2, 4), (1, 3)


def plain_spans(text, reach):
    found = []
    for kind, (_, pattern, good) in enumerate(PATTERNS):
        flags = re.ASCII | (re.IGNORECASE if kind == 0 else 0)
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if good(m)]
    out = []
    for a, kind, b in found:
        near = [(k, s, e) for s, k, e in found if s <= b + reach and e + reach >= a]
        apart = [k for k, s, e in near if s >= b or e <= a]
        identifier, secret = any(k in IDENTIFIER for k in apart), any(k in SECRET for k in apart)
        inside = any(k < 3 and s < b and e > a for k, s, e in near)
        if kind < 3 or not inside and {3: secret, 4: identifier, 5: identifier and secret}[kind]:
            out.append((a, kind, b))
    return ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def secret_texts(seed):
    rng = random.Random(seed)
    chars = lambda pool, n: "".join(rng.choice(pool) for _ in range(n))
    upper, low, mixed = "ABCDEFGHKZ0123456789", "0123456789abcdef", "abcXYZ0123456789+/"
    makers = [
        lambda: rng.choice(["password", "Token", "SECRET", "api_key", "apikey", "passwd"]) + rng.choice(['"', "", "'"]) + rng.choice([": ", "=", '  = "', ":"]) + chars(mixed, rng.randrange(3, 12)),
        lambda: "AKIA" + chars(upper, rng.randrange(10, 20)),
        lambda: chars(low, rng.randrange(18, 30)),
        lambda: "ASIA" + chars(upper, rng.randrange(8, 20)),
        lambda: chars(mixed, rng.randrange(28, 45)),
        lambda: rng.choice(["https", "postgres", "s3"]) + "://" + chars("abc.:@/", rng.randrange(2, 30)),
        lambda: chars("é x𝒳\n", rng.randrange(1, 120)),
        lambda: "secret: token: abcdefg",
    ]
    texts = ["".join(rng.choice(makers)() + rng.choice([" ", "\n", ", "]) for _ in range(rng.randrange(0, 14))) for _ in range(150)]
    return texts + ["key" + "=" * 5, "token=abcdef " * 400, "x" * 20000 + " AKIA" + "A1" * 300, "ſecret: abcdefgh, apiKey: abcdefgh"]


def test_secrets_equal_plain_python(spark):
    texts = secret_texts(5)
    rows = [(k, t, "d", 1, "k", 2, "f") for k, t in enumerate(texts)]
    rows += [(None, texts[3], *rows[0][2:]), (3, texts[3], *rows[0][2:]), (900, None, *rows[0][2:]), (901, "", *rows[0][2:])]
    got = find_secrets(spark.createDataFrame(rows, DOCS).repartition(3), reach=60).select("doc_id", shown(F.col("spans")).alias("s"), shown(base_spans(F.col("spans"))).alias("b")).collect()
    want = [(str(r[0]), plain_spans(r[1] or "", 60)) for r in rows]
    assert sorted((str(r.doc_id), r.s) for r in got) == sorted(want)
    assert all(r.b == ",".join(x for x in r.s.split(",") if x.split(":")[0] in ("assign", "access", "hex")) for r in got)
    assert {w.split(":")[0] for _, s in want for w in s.split(",") if w} == {p[0] for p in PATTERNS}
    assert find_secrets(spark.createDataFrame([], DOCS)).count() == 0


def test_weak_parts_need_their_complement(spark):
    key = "abcdefghijKLMNOPQRST0123456789abcDEF"
    texts = [f"x {key} y", f"ASIA0123456789ABCDEF {key}", "https://host.example/a", f"ASIA0123456789ABCDEF {key} https://host.example/a", f"ASIA0123456789ABCDEF {' ' * 300} {key}"]
    got = find_secrets(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", F.col("spans.kind").alias("k")).collect()
    assert {r.doc_id: r.k for r in got} == {0: [], 1: ["identifier", "key"], 2: [], 3: ["identifier", "key", "endpoint"], 4: []}


# Conversation repair


def plain_repair(rows):
    """All fields of the contract for rows (turn, role, text) after damage, by a search over every way."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in itertools.pairwise(initials))
    ways = {"": (0, "", ())}  # by role initials so far
    legal = re.compile("s|s?(ua)*u?")

    def widen(ways):
        out = dict(ways)
        for _ in range(3):
            for made, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    put(out, made + role[0], (cost + 3, audit + "I", (*lines, f"{role}:")))
        return out

    def put(ways, made, way):
        if legal.fullmatch(made) and (made not in ways or way[:2] < ways[made][:2]):
            ways[made] = way

    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for made, (cost, audit, lines) in widen(ways).items():
            put(after, made, (cost + 4, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if role:
                    put(after, made + role[0], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    put(after, made + new[0], (cost + 3 + more, audit + "R", (*lines, f"{new}:{text}")))
        best = min(w[0] for w in after.values())
        ways = {m: w for m, w in after.items() if w[0] <= best + 12}
    cost, audit, lines = min((w for made, w in widen(ways).items() if re.fullmatch("(s?(ua)+)?", made)), key=lambda w: w[:2])
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))


def talk(rng, longest):
    texts = ["Yes.", "no", "Why? ", "", " \t", "Go!\n", "so on ", "x.\x1f"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    return [(rng.choice([None, *range(6)]) if rng.random() < 0.2 else k, rng.choice(roles), rng.choice([*texts, f"Say {k}.", None])) for k in range(rng.randrange(longest))]


def digests(spark, turns, **options):
    from pairlens.operators.digests import ordered_digest

    found, made = repair.repair(turns, **options)
    said = ordered_digest(made, ["conv_id"], ["place"], repair.line(F.col("role"), F.col("text")), between="\n")
    said = {r.conv_id: r.digest for r in said.collect()}
    return {r.conv_id: (*r[1:], said.get(r.conv_id, sha(""))) for r in found.collect()}


@pytest.mark.parametrize("block", [3, 512])
def test_repair_equals_plain_search(spark, block):
    rng = random.Random(block)
    talks = {k: talk(rng, 9) or [(0, "user", "Hi.")] for k in range(150)} | {None: [(2, "user", "a."), (2, "user", "a."), (1, "assistant", "b")]}
    rows = [(k, *r, 1, "x") for k, t in talks.items() for r in t]
    got = digests(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long, fault string").repartition(3), block=block)
    blank = lambda v: " " if v is None else v
    want = {k: plain_repair([(t, blank(r), blank(x)) for t, r, x in rows_]) for k, rows_ in talks.items()}
    assert got == want


def test_repair_of_a_long_conversation_in_blocks(spark):
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant", "tool"]), rng.choice([f"Say {k}.", "cut", "", "Again."])) for k in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert digests(spark, turns, block=50) == digests(spark, turns, block=100_000)


def test_repair_query_equals_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        fault = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", r.text) if fault == 2 else r.text
        turns.setdefault(r.conv_id, []).extend([(r.turn, "user" if fault == 4 else r.role, text)] * {0: 0, 3: 2}.get(fault, 1))
    got = {r.conv_id: tuple(r[1:]) for r in queries.op12_conversation_repair(spark, folder).collect()}
    assert got == {k: plain_repair(t) for k, t in turns.items()}


def test_repair_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string, copies int"
    found, made = repair.repair(spark.createDataFrame([], kind), copies="copies")
    assert found.count() == made.count() == 0
    found, made = repair.repair(spark.createDataFrame([(4, 1, "user", "x", 0)], kind), copies="copies")
    assert [tuple(r) for r in found.collect()] == [(4, 0, 0, 0, 0, 0, 0, "")] and made.count() == 0


# Fill-in-the-middle


def plain_middle(doc_id, text):
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}")


def test_middle_equals_plain_python(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "Word", " ", "<", ">", "P", "é", "\n", "𝒳", "0", "<S", "M>"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += ["", None, "a" * 9000, "é" * 5000, "<P>", "one <M> two", "word " * 40_000, "x" * 3000 + "<" + "y" * 3000]
    rows = [(k, t, "d", 1, "k", 2, "f") for k, t in enumerate(texts)] + [(None, "no id here", *("d", 1, "k", 2, "f")), (5, texts[5], *("d", 1, "k", 2, "f"))]
    made = middle.restored(middle.fill_in_middle(spark.createDataFrame(rows, DOCS)))
    got = sorted((str(r.doc_id), *map(str, r[1:6]), r.restored) for r in made.collect())
    assert got == sorted((str(r[0]), *map(str, plain_middle(r[0], r[1] or "")), r[1] or "") for r in rows)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


def test_ropes_of_any_leaf_size(monkeypatch):
    rng = random.Random(3)
    for leaf in (1, 2, 7, 64):
        monkeypatch.setattr(middle, "LEAF", leaf)
        for _ in range(300):
            text = "".join(rng.choice("ab<P>S é\n𝒳") for _ in range(rng.randrange(50)))
            doc_id = rng.randrange(1 << 30)
            h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
            out = middle.rearranged(text, *(int(h[8 * k : 8 * k + 8], 16) for k in range(4)), 90, 20)
            assert out == plain_middle(doc_id, text)
            assert middle.put_back(out[4], out[1]) == text


@pytest.mark.parametrize("name", ["op11_secret_scan", "op12_conversation_repair", "op13_fill_in_middle"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = con.execute(queries.ORACLE_SQL[name])
    names = sorted(c[0] for c in want.description)
    rows = [dict(zip([c[0] for c in want.description], r, strict=True)) for r in want.fetchall()]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == names
    assert sorted(str([r[c] for c in names]) for r in got.collect()) == sorted(str([r[c] for c in names]) for r in rows)

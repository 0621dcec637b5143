"""Corpus operators against plain Python, with nulls, empty tables, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pairlens.llm import packing, queries
from pairlens.llm.chat import chat_windows, read_windows
from pairlens.llm.decontaminate import _words, contaminated, drop_contaminated, weighted_similarity
from pairlens.llm.html_text import extract_pages, main_text
from pairlens.llm.near_copies import Tiles, common, drop_near_copies
from pairlens.llm.neighbours import nearest
from pairlens.llm.packing import best_fit_packing
from pairlens.llm.simhash import _shingles, fingerprint, near_links, simhash_groups
from pairlens.llm.suffix_dedup import Suffixes, suffix_dedup
from pairlens.llm.token_output import Shard, pack_shard, token_output
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, uid long, found string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    shared = words(rng, 80)
    rows = [(i, words(rng, rng.randrange(1, 120)), "en", 1, "x") for i in range(40)]
    rows += [(100 + i, words(rng, 30) + " " + shared[: 300 - i] + " " + words(rng, 20), "en", 1, "x") for i in range(6)]
    rows += [(200 + i, rows[3][1], "en", 1, "x") for i in range(3)]
    rows += [(300, None, None, None, None), (301, "", "en", 1, "x"), (302, "a" * 450, "en", 1, "x"), (303, "é" * 150 + "b" + "é" * 150, "en", 1, "x"), (None, rows[5][1], "en", 1, "x"), (100, rows[41][1], "en", 1, "x")]
    return rows


def removed_by_brute_force(texts, length):
    seen = {}
    for k, t in enumerate(texts):
        for a in range(len(t) - length + 1):
            seen.setdefault(t[a : a + length], []).append((k, a))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                gone[k][a : a + length] = True
    return gone


@pytest.mark.parametrize(("most", "known"), [(20_000, 4_000_000), (2, 0)])
def test_suffix_dedup_equals_brute_force(spark, most, known):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, texts, removed_by_brute_force(texts, 200), strict=True):
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        want.append((str(r[0]), len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    got = suffix_dedup(spark.createDataFrame(rows, DOCS), most_contexts=most, most_known=known).drop("text").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    assert suffix_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_sort_equals_plain_sort():
    rng = np.random.default_rng(2)
    code = rng.integers(97, 99, 600).astype(np.uint8)
    start = np.arange(500)
    order, common = Suffixes(code, start, np.minimum(start + 60, 600)).sorted()
    raw = code.tobytes()
    assert [raw[k : k + 60] for k in order] == sorted(raw[k : k + 60] for k in range(500))
    assert common[0] == 0


def test_simhash_groups_equal_brute_force(spark):
    rows = corpus(3)
    prints = [fingerprint((r[1] or "").encode()) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = min(root[i], root[j])
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root[k]] = min(least.get(root[k], r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", str(least.get(root[k]))) for k, (r, p) in enumerate(zip(rows, prints, strict=True)))
    got = simhash_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert simhash_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_nearest_reaches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (920, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(table, table.where("vec_id % 20 = 0"), k=20).toPandas()
    score = x.astype(float) @ x.T.astype(float)
    np.fill_diagonal(score, -np.inf)
    hits = sum(len(set(np.argsort(-score[q])[:20]) & set(got[got.query_id == q].vec_id)) for q in range(0, 400, 20))
    assert len(got) == 400 and hits / 400 >= 0.9
    assert nearest(table.limit(0), table.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n, 5000)) for i, n in enumerate((12, 30, 60, 3))] + [(8, None), (9, "")]
    copy = items[2][1].split()
    copy[30] = "other"
    docs = [(1, words(rng, 50) + " " + items[0][1] + " " + words(rng, 9), "", 1, ""), (2, " ".join(copy), "", 1, ""), (3, words(rng, 200, 5000), "", 1, ""), (4, None, "", 1, ""), (5, "", "", 1, ""), (6, items[3][1].upper(), "", 1, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(spark.createDataFrame(docs, DOCS), bench).collect()
    assert weighted_similarity(copy, items[2][1].split()) >= 0.8
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 2), (6, 3)]
    assert contaminated(spark.createDataFrame(docs, DOCS), bench.limit(0)).count() == 0


def windows_by_brute_force(text, items):
    """{item: (first word, words, similarity)} of the best window over all windows of a text."""
    own, found = _words(text), {}
    for i, item in enumerate(items):
        asked = _words(item or "")
        n = min(len(asked), len(own))
        for start in range(len(own) - n + 1 if n else 0):
            part = own[start : start + n]
            alike = float(part == asked) if min(len(part), len(asked)) < 5 else weighted_similarity(part, asked)
            if alike >= 0.8 and alike > found.get(i, (0, 0, 0))[2]:
                found[i] = (start, n, alike)
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [words(rng, n, 5000) for n in (5, 6, 9, 12, 15, 30, 60, 3, 1, 4)] + [None, "", words(rng, 20, 3)]
    texts = []
    for _ in range(150):
        part = (items[rng.choice((0, 1, 2, 3, 4, 5, 6, 7, 9, 12))]).split()
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(part))
            part[k : k + rng.randrange(2)] = ["new"] * rng.randrange(2)
        texts.append(f"{words(rng, rng.randrange(40), 3000)} {' '.join(part).upper()}, {words(rng, rng.randrange(40), 3000)}")
    texts += [None, "", items[8], items[7], f"{items[6]} {items[6]}", " ".join(items[5].split()[:26]), texts[0], "x " * 4000 + items[4]]
    rows = [(i if i != 5 else None, t, "", 1, "") for i, t in enumerate(texts)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted((str(rows[k][0]), i, *w) for k, t in enumerate(texts) for i, w in windows_by_brute_force(t or "", items).items())
    for size in (32 << 20, 100):
        got = contaminated(spark.createDataFrame(rows, DOCS), bench, block_bytes=size).collect()
        assert sorted((str(r.doc_id), r.item_id, r.window_start, r.n_words, r.similarity) for r in got) == want
        kept = drop_contaminated(spark.createDataFrame(rows, DOCS), bench, block_bytes=size)
        gone = {k for k, t in enumerate(texts) if windows_by_brute_force(t or "", items)}
        assert kept.columns == ["doc_id", "text", "lang", "uid", "found"]
        assert Counter(str(r.text) for r in kept.collect()) == Counter(str(t) for k, t in enumerate(texts) if k not in gone)
    assert len(want) > 60


def test_tiles_of_many_chunks_lose_no_link(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ np.uint64(1 << k) for k in range(20)] + [base ^ np.uint64(3 << k) for k in range(0, 60, 7)]))
    links = near_links(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), 3, rows_per_tile=3).collect()
    root = {int(x): int(x) for x in prints.view(np.int64)}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3
        root[top(a)] = top(b)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    for i, j in zip(*np.nonzero(near), strict=True):
        assert top(int(prints.view(np.int64)[i])) == top(int(prints.view(np.int64)[j]))


def triplets(rng, bins):
    """Lengths of which three fill a bin of 1000 each, where best fit mostly fails."""
    out = []
    for _ in range(bins):
        a, b = rng.integers(250, 500, 2)
        while not 250 <= 1000 - a - b < 500:
            a, b = rng.integers(250, 500, 2)
        out += [a, b, 1000 - a - b]
    return np.array(out)


def test_genetic_packing_beats_best_fit(spark):
    rng = np.random.default_rng(3)
    lengths = triplets(rng, 40)
    plain = np.zeros(len(lengths), np.int32)
    first = packing.best_fit(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), [], plain, 0, 1000)
    isle = packing.Island(lengths, 1000, 7)
    isle.start()
    assert isle.pop[0][0] > isle.least == 40  # best fit misses the bound
    isle.evolve(300)
    assert isle.pop[0][0] < first
    fill = np.bincount(isle.pop[0][2], lengths)
    assert fill.max() <= 1000 and fill.sum() == lengths.sum()
    rows = [(i, 0, 0, int(x), 0, i) for i, x in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, packing.PIECE)
    bins = {}
    for epochs in (1, 4):
        got = packing.pack_pieces(pieces, 1000, islands=3, epochs=epochs, generations=40).toPandas()
        assert sorted(got.doc_id) == list(range(len(lengths))) and got.groupby("sequence_id").length.sum().max() <= 1000
        bins[epochs] = got.sequence_id.nunique()
    assert bins[4] <= bins[1] and bins[4] < first  # further epochs begin with their neighbours' elites


def test_crossover_keeps_whole_bins():
    rng = np.random.default_rng(3)
    lengths = triplets(rng, 12)
    isle = packing.Island(lengths, 1000, 1)
    isle.start()
    a, b = isle.pop[0][2], isle.pop[1][2]
    child = isle.child(a, b)
    of = lambda owner: {frozenset(np.flatnonzero(owner == k).tolist()) for k in np.unique(owner)}
    assert of(child) & of(b) and np.bincount(np.unique(child, return_inverse=True)[1], lengths).max() <= 1000


def test_nearest_of_ties_repeats_and_clashing_columns(spark):
    x = [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [2.0, 0.0], [0.6, 0.8], [-1.0, 0.0], [1.0, 0.0]]
    rows = [(i, v, 1, 0, "t") for i, v in enumerate(x)] + [(3, [0.5, 0.0], 1, 0, "t"), (None, [9.0, 0.0], 1, 0, "t"), (8, [], 1, 0, "t"), (9, [1.0], 1, 0, "t")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int, rank int, score string")
    got = nearest(table, table.where("vec_id = 0"), k=4).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 6, 1.0), (0, 4, 4, 0.6)]
    floats = table.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert [r.vec_id for r in nearest(floats, floats.where("vec_id = 0"), k=9).orderBy("rank").collect()] == [3, 1, 6, 4, 2, 5]


def test_language_and_quality_of_odd_rows(spark):
    from pairlens.llm import lang_id, quality

    rng = random.Random(6)
    docs = [(i, (words(rng, 60) if i % 2 else "der die das und nicht " * 9), "xy"[i % 2], 1, "s") for i in range(60)]
    docs += [(None, None, None, 1, ""), (70, "", "x", 1, ""), (70, "12 34 !", "x", 1, ""), (71, "der die das " * 60_000, "x", 1, ""), (1, docs[1][1], "y", 1, "s")]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, score int, held_out string")
    held = F.lit(False)
    found = lang_id.predict(table, lang_id.train(table), held).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    assert sorted(r.lang_pred for r in found if r.doc_id in (None, 70)) == ["und"] * 3 and {r.lang_pred for r in found if r.doc_id == 71} == {"x"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, None), (None, 1), (2, 7), (999, 1)], "doc_id long, quality int")
    scored = quality.score(table, quality.train(table, labels), held).collect()
    assert len(scored) == len(docs) and all(r.predicted == (r.score >= 0.3) for r in scored)
    by = {}
    for r in scored:
        by.setdefault(r.doc_id, set()).add(round(r.score, 6))
    assert len(by[1]) == 1 and max(by[71]) < 0.3 < min(by[1])


def test_features_are_characters_not_bytes():
    from pairlens.llm.quality import features

    bucket, bounds = features(["é é", "", "ab ab ab"])
    assert np.diff(bounds).tolist() == [2 + 2 + 1, 0, 6 + 3 + 3 + 2]
    again, _ = features(["é é"])
    assert (bucket[: bounds[1]] == again).all()


def test_pair_grammar_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(1)
    for n, k in ((0, 5), (1, 5), (5000, 30), (20_000, 4), (3000, 1), (50_000, 3000)):
        ids = rng.integers(0, k, n).astype(np.uint32)
        shard = Shard(pack_shard(ids, np.array([n])))
        assert (shard.all() == ids).all()
        pairs = list(zip(shard.symbols[:-1].tolist(), shard.symbols[1:].tolist(), strict=True))
        assert max(Counter(pairs).values(), default=0) < 8
        for a, b in rng.integers(0, n + 1, (20, 2)).tolist():
            assert (shard.slice(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, ("system", "user", "assistant")[t % 3] if t < 2 else ("assistant", "user")[t % 2], words(rng, rng.randrange(0, 400))) for c in range(4) for t in range(9)]
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (5, 0, "assistant", None), (6, 0, None, "<x>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows(turns, budget=400, history_tokens=100)
    got = {r.conv_id: r for r in read_windows(windows).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == conv)
        plain = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(plain.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    # Beyond the budget is only what one turn alone takes; small turns fill windows.
    for r in windows.collect():
        own = r.text.count("</turn>") - r.n_context - (r.window == 1 and r.text.startswith("<system>"))
        assert r.tokens <= 400 or own == 1
    small = spark.createDataFrame([(1, t, ("user", "assistant")[t % 2], "<some words " + "x" * (t % 40)) for t in range(600)] + [(1, 5, "user", "again")] * 2, "conv_id long, turn long, role string, text string")
    filled = chat_windows(small, budget=400, history_tokens=60).collect()
    assert max(r.tokens for r in filled) <= 400 and sum(r.tokens for r in filled) / len(filled) > 300
    one = read_windows(chat_windows(small, budget=400, history_tokens=60)).first()
    assert one.n_turns == 602
    assert read_windows(chat_windows(turns.limit(0))).count() == 0


def test_shard_random_access():
    ids = np.random.default_rng(6).integers(0, 30, 5000).astype(np.uint32)
    shard = Shard(pack_shard(ids, np.array([5000])))
    assert (shard.all() == ids).all() and len(shard.symbols) < 5000
    for a, b in ((0, 1), (17, 400), (4999, 5000), (10, 10)):
        assert (shard.slice(a, b) == ids[a:b]).all()


def encoded(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(queries.tokenizer(name)).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_output_equals_library(spark):
    rows = [r for r in corpus(7) if r[0] is not None and r[0] != 100]
    rows.append((400, "Tab\there  two — naïve Ünï\n\n x <|endoftext|> 12,345", "", 1, ""))
    got = {r.doc_id: r for r in token_output(spark.createDataFrame(rows, DOCS), queries.tokenizer("byte_bpe_50k.json")).collect()}
    start = 0
    for r in sorted(rows):
        ids = encoded("byte_bpe_50k.json", r[1], 2)
        assert (got[r[0]].start, got[r[0]].n_tokens, got[r[0]].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing_is_whole_and_gapless(spark):
    rows = corpus(8) + [(500, words(random.Random(9), 9000), "", 1, "")]
    got = best_fit_packing(spark.createDataFrame(rows, DOCS), queries.tokenizer("word_bpe_49k.json")).toPandas()
    for doc, text in ((500, rows[-1][1]), (300, None), (0, rows[0][1])):
        ids, mine = encoded("word_bpe_49k.json", text, 1), got[got.doc_id == doc].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 4096))
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in mine.start]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset.to_numpy() == np.concatenate(([0], np.cumsum(seq.length)[:-1]))).all() and seq.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_packing_of_many_empty_texts_ends(spark, monkeypatch):
    levels, pack_level = [], packing.pack_level

    def counted(*args):
        levels.append(args)
        assert len(levels) < 9
        return pack_level(*args)

    monkeypatch.setattr(packing, "pack_level", counted)
    rows = [(i, None if i % 2 else "", "", 0, "") for i in range(3000)]
    rows += [(i, "some words of a short text " * 20, "", 0, "") for i in range(3000, 3300)]
    for some in (rows[:3000], rows):
        levels.clear()
        got = best_fit_packing(spark.createDataFrame(some, DOCS), queries.tokenizer("word_bpe_49k.json"), block_items=256).toPandas()
        assert sorted(got.doc_id) == [r[0] for r in some]
        for _, seq in got.sort_values("offset").groupby("sequence_id"):
            assert (seq.offset.to_numpy() == np.concatenate(([0], np.cumsum(seq.length)[:-1]))).all() and seq.length.sum() <= 4096
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_main_text():
    html = "<html><body><nav>Home About</nav><div class='content'><h1>Title &amp; more</h1><p>First  paragraph of a\n long enough article text.</p><p>Second one with a <a href='#'>link</a> in it.</p></div><footer>Footer</footer></body></html>"
    assert main_text(html) == "Title & more\nFirst paragraph of a long enough article text.\nSecond one with a link in it."
    assert main_text("") == "" and main_text("<script>x</script>") == ""


PARAGRAPHS = [f"Paragraph {i} of a text that is long enough to be the main text of a page, as it has some plain words." for i in range(6)]


@pytest.mark.parametrize("marks", ["style='overflow:hidden'", "title='the hidden cost'", "data-id='comment-3'", "class='content has-sidebar'", "class='post no-comments'", "id=search-results-article", "role='form'"])
def test_main_text_in_an_element_named_like_no_article(marks):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    for html in ("<body><nav><a href='/'>Home</a></nav><div {}>{}</div><footer>Footer</footer></body>", "<body><div {}><div class='sidebar'>Other news</div><div>{}</div></div></body>", "<body><main><div {}>{}</div></main><aside>Other</aside></body>"):
        assert main_text(html.format(marks, body)) == "\n".join(PARAGRAPHS)
    article = f"<article><p>{PARAGRAPHS[0]}</p></article>"
    for html in ("<body>{}<div class='comments'>{}</div></body>", "<body><div class='has-sidebar'>{}<div class='comments'>{}</div></div></body>", "<body>{}<div hidden>{}</div></body>"):
        assert main_text(html.format(article, body)) == PARAGRAPHS[0]


@pytest.mark.parametrize("marks", ["class='layout has-sidebar'", "id='page' class='no-sidebar'", "class='login-required'"])
def test_main_text_needs_no_element_names(marks):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:3]) + "<p class='related-work'>Related work of others.</p><p class='notice-period'>A short notice period.</p>"
    want = "\n".join([*PARAGRAPHS[:3], "Related work of others.", "A short notice period."])
    links = "<ul>" + "".join(f"<li><a href='/{i}'>Other page {i}</a></li>" for i in range(9)) + "</ul>"
    assert main_text(f"<body><div {marks}><div>{links}</div><div>{body}</div><div>{links}</div></div></body>") == want
    assert main_text(f"<body><div {marks}><article>{body}</article></div><div class='ad'>Buy this now, it is cheap.</div></body>") == want


def test_main_text_equals_the_article_of_every_page():
    import re
    from html import unescape

    rows = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html
    for html in rows:
        inner = html[html.index("<article>") : html.index("</article>")]
        blocks = re.split(r"</?(?:article|p|h1)\b[^>]*>", re.sub(r"<br\s*/?>", " ", inner))
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert main_text(html) == "\n".join(x for x in lines if x)


@pytest.mark.parametrize("html", ["<a" * 20_000, "<i>" * 20_000 + "</b>" * 20_000, "<div>" * 5000 + "x", "<a '" * 20_000, "<a b='" * 20_000, "<article>" + "<i>" * 20_000 + "</div>" * 20_000, "<li><i>" * 5000, "<!--" * 50_000])
def test_main_text_of_broken_pages_takes_no_long_time(html):
    import time

    start = time.perf_counter()
    main_text(html)
    assert time.perf_counter() - start < 3


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", "<p>One</p>", "a"), (1, "u", "<p>One</p>", "a"), (None, None, None, "b"), (3, "", "", "c"), (4, "v", "<p>" + "long words " * 200_000 + "</p>", "d")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((str(r.page_id), str(r.url), r.text[:10], r.n_chars) for r in got) == [("1", "u", "One", 3), ("1", "u", "One", 3), ("3", "", "", 0), ("4", "v", "long words", 2_199_999), ("None", "None", "", 0)]


def test_main_text_of_several_articles():
    parts = [f"<article><h2>Part {i}</h2>" + f"<p>{PARAGRAPHS[i]}</p>" * n + "</article>" for i, n in enumerate((9, 2, 1))]
    whole = [line for i, n in enumerate((9, 2, 1)) for line in [f"Part {i}", *[PARAGRAPHS[i]] * n]]
    nav, foot = "<nav><a href='/'>Home</a></nav>", "<div><a href='/a'>Other news</a> <a href='/b'>More news</a></div><footer>Footer</footer>"
    title, lead = "<h1>A title</h1>", "<p class='lead'>A short lead.</p>"
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        want = [line for i in order for line in [f"Part {i}", *[PARAGRAPHS[i]] * (9, 2, 1)[i]]]
        mine = "".join(parts[i] for i in order)
        assert main_text(f"<body>{nav}<main>{title}{lead}{mine}</main>{foot}</body>") == "\n".join(["A title", "A short lead.", *want])
        assert main_text(f"<body>{nav}<div>{title}</div>{mine}{foot}</body>") == "\n".join(["A title", *want])
    wrapped = "".join(f"<div class='part'>{p}</div>" for p in parts)
    assert main_text(f"<body>{nav}{title}<section>{wrapped}</section>{foot}</body>") == "\n".join(["A title", *whole])
    assert main_text(f"<body>{title}{parts[0]}<article><a href='/c'>Read this next</a></article>{foot}</body>") == "\n".join(["A title", *whole[:10]])


def test_classifiers_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = queries.table(spark, folder, "documents").toPandas()
    lang = queries.op1_language_id(spark, folder).toPandas().merge(docs[["doc_id", "lang"]])
    lang = lang[lang.held_out & lang.lang.notna() & (lang.lang_pred != "und")]
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    labels = queries.table(spark, folder, "labels").toPandas()
    scored = queries.op2_quality_classifier(spark, folder).toPandas().merge(labels)
    scored = scored[scored.held_out & scored.quality.notna()]
    assert (scored.quality == scored.predicted).mean() > 0.85
    assert pd.api.types.is_float_dtype(scored.score) and scored.score.between(0, 1).all()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "embeddings", "pages", "conversations", "benchmark"):
        queries.table(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == (1 if name == "op7_chat_formatting" else 0), name


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = queries.table(spark, folder, "documents").select(*corpus_pipeline.COLUMNS)
    before = docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "t")
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS and 0 < docs.count() <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert docs.where(F.col("text").isNull()).count() <= 5


def shingle_set(text):
    return np.unique(_shingles((text or "").encode(), 5, 42))


def alike(a, b):
    x, y = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(x & y) / len(x | y) if x | y else 1.0


def test_just_alike_enough():
    """28 of 35 shingles in common are 0.8, whatever 0.8 * 35 is in floating point."""
    rows = np.zeros((2, 7), np.int64)
    rows[:, 4], rows[:, 5], rows[:, 6] = (31, 32), (0, 1), (0, 1)
    for n in (28, 27):
        sets = [np.arange(31, dtype=np.uint64), np.concatenate((np.arange(n), np.arange(100, 132 - n))).astype(np.uint64)]
        assert len(Tiles(rows, None, 0.8).verified(sets)) == (n == 28)


def test_common_counts_equal_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 200, 400)]
    got = common(sets, sets[::-1], width=64)
    assert got.tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in sets[::-1]] for x in sets]


def test_near_copies_of_a_large_cloud_below_the_similarity(spark, monkeypatch):
    """Many texts that are near by fingerprint and just not alike enough: all stay, but for true copies."""
    from pairlens.llm import near_copies

    rng = random.Random(12)
    base = words(rng, 120, 5000).split()
    rows = []
    for i in range(260):
        new = list(base)
        for k in rng.sample(range(len(new)), 6):
            new[k] = f"n{i}x{k}"
        rows.append((i, " ".join(new)))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 260, 20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    original = near_copies.sound_links
    monkeypatch.setattr(near_copies, "sound_links", lambda *a, **k: original(*a, **k, rows_per_chunk=60))
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = sorted({rows[top(k)][0] for k in range(len(rows))})
    assert sorted(r.doc_id for r in drop_near_copies(table).collect()) == want and 200 < len(want) <= 260


def test_a_large_group_is_linked_once(spark, monkeypatch):
    """Chunks of one group of near copies are linked as groups, not row by row in each pair of chunks."""
    from pairlens.llm import near_copies

    rng = random.Random(21)
    base = words(rng, 120, 5000).split()
    rows = [(i, " ".join([*base[: 5 + i % 100], f"n{i}", *base[6 + i % 100 :]])) for i in range(300)]
    sound, tiles, counts = near_copies.sound_links, near_copies.candidate_links, {}

    def counted(name, links):
        counts[name] = links.count()
        return links

    monkeypatch.setattr(near_copies, "candidate_links", lambda *a: counted("near", tiles(*a, rows_per_tile=20)))
    monkeypatch.setattr(near_copies, "sound_links", lambda *a: counted("sound", sound(*a, rows_per_chunk=20)))
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert 299 <= counts["sound"] <= 299 + 15 * 14 // 2 and counts["near"] <= 40 * 299


def test_components_read_joined_links_once(spark, monkeypatch):
    from pairlens.llm import simhash

    rng = random.Random(22)
    links = [(i, j) for i in range(60) for j in range(i)]  # one dense group
    links += [(1000 + i, 1001 + i) for i in range(70)] + [(2500, 2000 + i) for i in range(50)] + [(3000, 3000)]
    links += [(rng.randrange(4000, 4400), rng.randrange(4000, 4400)) for _ in range(180)]
    root = {x: x for link in links for x in link}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    original, rows = simhash.stored, []

    def counted(df, label):
        rows.append((out := original(df, label)).count())
        return out

    table = original(spark.createDataFrame(links, "a long, b long"), "links")
    monkeypatch.setattr(simhash, "stored", counted)
    got = {r.node: r.root for r in simhash.components(table).collect()}
    assert got == {k: top(k) for k in root}
    assert sum(rows) < 2 * len(links), rows
    assert simhash.components(table.limit(0)).count() == 0


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(1, 150), 5000)) for i in range(60)]
    for i in range(60, 140):
        new = (rows[rng.randrange(12, 40)][1] if i % 2 else rows[3][1]).split()
        for _ in range(rng.randrange(0, 4)):
            new[rng.randrange(len(new))] = f"n{i}"
        rows.append((i, " ".join(new).upper() if i % 5 == 0 else " ".join(new)))
    rows += [(200, None), (201, ""), (202, " \n"), (None, rows[20][1]), (20, rows[20][1]), (None, "only here without an id"), (203, "é " * 4000)]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i][1], rows[j][1]) >= 0.8:
                root[top(i)] = top(j)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(top(k), []).append((r[0] is None, r[0] or 0, k))
    want = sorted((str(rows[k][0]), str(rows[k][1])) for k in (min(g)[2] for g in groups.values()))
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, uid int, node string")
    kept = drop_near_copies(table)
    assert kept.columns == table.columns
    got = sorted((str(r.doc_id), str(r.text)) for r in kept.collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert 1 < len(groups) < len(rows) - 40
    assert drop_near_copies(table.limit(0)).count() == 0


def test_near_copies_of_many_short_texts(spark):
    rng = random.Random(3)
    rows = []
    for i in range(0, 6000, 2):
        text = words(rng, 8, 5000).split()
        rows += [(i, " ".join(text)), (i + 1, " ".join([*text, f"n{i}"] if i % 4 else [f"n{i}", *text]))]
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 6000, 2))


def test_tiles_join_what_is_near():
    rng = np.random.default_rng(5)
    base = rng.integers(-(1 << 63), 1 << 63, (3, 4), dtype=np.int64)
    rows = np.array([[*(base[k % 3] ^ (1 << rng.integers(0, 60, 4))), 100 + k % 7, k, k] for k in range(1500)], np.int64)
    links = Tiles(rows, None, 0.8).forest()
    assert len(links) == 1497 and all(a % 3 == b % 3 for a, b in links)
    assert all((a < 700) != (b < 700) for a, b in Tiles(rows[:700], rows[700:], 0.8).forest())
    sets = [np.arange(k % 3 * 100, k % 3 * 100 + 100 + k % 7, dtype=np.uint64) for k in range(1500)]
    links = Tiles(rows, None, 0.8).verified(sets)
    assert len(links) == 1497 and all(a % 3 == b % 3 for a, b in links)
    sets = [np.arange(k * 1000, k * 1000 + 100, dtype=np.uint64) for k in range(1500)]
    assert not Tiles(rows, None, 0.8).verified(sets)

"""Parts of the corpus operators against separate plain ones: kernel, gradient, densities, fingerprints, item index; null and repeated keys."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pairlens.llm import decontaminate, html_text, lang_id, quality, queries, suffix_dedup, tokens
from pairlens.llm.chat import chat_windows, read_windows
from pairlens.llm.packing import best_fit_packing
from pairlens.llm.simhash import fingerprint
from pairlens.llm.token_output import token_output

DOCS = "doc_id long, text string, lang string, start long, length long"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


# Language kernel against sets of n-grams


def bucket_of(gram):
    """A word's n-gram, blanks for its edges, to its place in the hashed space."""
    code = [0 if c == " " else ord(c) for c in gram]
    key = code[0] if len(code) == 1 else code[0] << 20 | code[1] if len(code) == 2 else (code[0] << 20 | code[1]) << 20 | code[2]
    key = (key + (1 << 59 + len(code))) & ((1 << 64) - 1)
    return (key * 0x9E3779B97F4A7C15 & ((1 << 64) - 1)) >> (64 - lang_id.BITS)


def grams(text):
    out = set()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        edged = f" {word} "
        out |= set(word) | {edged[k : k + 2] for k in range(len(edged) - 1)} | {edged[k : k + 3] for k in range(len(edged) - 2)}
    return {bucket_of(g) for g in out}


def test_language_kernel_equals_sets():
    texts = ["Le chat, là-bas; 42 Été!", "", "der Hund", "x", "Ein  ganz langer\nText über das Wetter", "... 7 _", "LE CHAT"]
    x, has = lang_id.presence(texts)
    sets = [grams(t) for t in texts]
    assert [set(np.flatnonzero(r).tolist()) for r in x] == sets
    assert has.tolist() == [bool(s) for s in sets]
    k = lang_id.kernel(x, x)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert k[i, j] == pytest.approx(len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1)), abs=1e-6)


# Quality training against loops over features


def test_gradient_steps_equal_plain_ones():
    texts = ["good words here", "bad bad stuff", "good good text here", "junk 123 junk", "fine words", ""]
    labels = np.array([1, 0, 1, 0, 1, 0])
    samples = []
    for t in texts:
        ids, count = np.unique(quality.features([t])[0], return_counts=True)
        samples.append((ids.astype(np.int64), count.astype(np.float32)))
    dim, epochs, rate, batch, seed = 4, 3, 0.5, 2, 9
    model = quality.fit(samples, labels, dim=dim, epochs=epochs, rate=rate, batch=batch, seed=seed, least_steps=1)
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    v = (rng.random((1 << quality.BITS, dim)) - 0.5) / dim
    layer, bias = np.zeros((dim, 2)), np.array([0.0, math.log(share / (1 - share))])
    use = [i for i, (s, _) in enumerate(samples) if len(s)]
    steps, done = epochs * -(-len(use) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(use)
        for a in range(0, len(order), batch):
            now = rate * (1 - done / steps)
            moves, grad_layer, grad_bias = Counter(), np.zeros((dim, 2)), np.zeros(2)
            for i in order[a : a + batch]:
                ids, count = samples[i]
                mean = sum(c / count.sum() * v[f] for f, c in zip(ids, count, strict=True))
                p = np.exp(mean @ layer + bias)
                p /= p.sum()
                p[labels[i]] -= 1
                for f, c in zip(ids, count, strict=True):
                    moves[f] = moves[f] + now * c / count.sum() * (layer @ p)
                grad_layer += np.outer(mean, p)
                grad_bias += p
            for f, move in moves.items():
                v[f] -= move
            layer -= now / batch * 8 * grad_layer
            bias -= now / batch * grad_bias
            done += 1
    assert model.odds == pytest.approx(v @ (layer[:, 1] - layer[:, 0]), abs=1e-4)
    assert model.constant == pytest.approx(bias[1] - bias[0], abs=1e-4)


def test_no_feature_stands_for_all_words():
    """A word said twice is a pair like any other: two such words share no feature but those of their letters."""
    a, b = (set(quality.features([t])[0].tolist()) for t in ("kxq kxq", "vzj vzj"))
    assert not a & b


# Text densities against a walk over a plain tree


def plain_counts(node):
    """[chars, tags, link chars, link tags] below a node; inline tags are counted where they are read."""
    out = [0, node.tags, 0, node.link_tags]
    for child in node.children:
        if isinstance(child, tuple):
            n = len(" ".join(child[0].split()))
            out = [out[0] + n, out[1], out[2] + n * bool(child[1]), out[3]]
        elif isinstance(child, html_text.Node) and not child.out:
            out = [a + b for a, b in zip(out, plain_counts(child), strict=True)]
            out[1] += 1
    return out


def plain_density(node, share):
    c, t, lc, lt = plain_counts(node)
    t, lt = max(t, 1), max(lt, 1)
    if not c or not lc:
        return c / t
    base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
    return c / t * min(1.0, max(0.0, math.log(max(c / lc * t / lt, 1 + 1e-9)) / math.log(max(base, 1 + 1e-9))))


def test_densities_equal_a_plain_walk():
    pages = ["<html><body><div><p>Some text of a page, <a href=x>a link</a> in it.</p><p>More text.</p></div><div><a href=y>one</a> <a href=z>two</a></div></body></html>", "<p>only</p>", "<div><div><div>deep " + "word " * 200 + "</div></div><ul><li><a>x</a><li>y</ul></div>"]
    import pandas as pd

    pages += pd.read_parquet("/root/testdata/sf0.001/pages.parquet").html.dropna().tolist()[:25]
    for page in pages:
        root = html_text.parse(page)
        html_text._settle(root)
        chars, _, link_chars, _ = plain_counts(root)
        share, todo, want = link_chars / max(chars, 1), [root], []
        while todo:
            node = todo.pop()
            inner = [c for c in node.children if isinstance(c, html_text.Node) and not c.out]
            want.append((node, plain_density(node, share), sum(plain_density(c, share) for c in inner)))
            todo += inner
        assert len(html_text._measure(root)) == len(want)
        for node, density, total in want:
            assert (node.density, node.total) == pytest.approx((density, total))


# Fingerprints


def plain_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    said = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(said[k : k + 3]) for k in range(len(said) - 2)] if len(said) >= 3 else [" ".join(said)] if said else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_separate_ones():
    rng = random.Random(4)
    texts = ["", " \t\n", "One", "one TWO", "É É É é", "a b c a b c a b c", "x\x1fy z\xa0w v", *[words(rng, rng.randrange(1, 60), 30).title() for _ in range(60)]]
    assert [fingerprint(t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


# Item index


def test_blocks_select_and_lose_nothing_within_the_radius():
    rng = random.Random(6)
    index = decontaminate.ItemIndex(list(range(3000)), [words(rng, 30) for _ in range(3000)], 0.8)
    (size,) = index.sizes
    left = []
    for k in range(0, 3000, 30):
        fp = size.prints[k].copy()
        flips = rng.sample(range(256), rng.randrange(size.radius + 1))
        for b in flips:
            fp[b // 8] ^= 1 << b % 8
        near = {i: d for i, d in size.near(fp)}
        distance = np.bitwise_count(size.prints ^ fp).sum(1)
        assert near == {i: int(distance[i]) for i in np.flatnonzero(distance <= size.radius)} and near[k] == len(flips)
        left.append(len(size.candidates(fp)) / 3000)
    assert np.mean(left) < 0.2


def test_windows_just_alike_enough_are_found():
    rng = random.Random(8)
    texts = [words(rng, 40) for _ in range(300)]
    index = decontaminate.ItemIndex(list(range(300)), texts, 0.8)
    found = asked = 0
    for i, t in enumerate(texts):
        changed = t.split()
        changed[0] = "new"
        changed[rng.choice([2, 38, 39])] = "other"
        if decontaminate.weighted_similarity(changed, t.split()) >= 0.8:
            asked += 1
            found += any(r[1] == i for r in index.search([words(rng, 20) + " " + " ".join(changed) + " " + words(rng, 5)]))
    assert asked > 150 and found >= 0.99 * asked


def test_benchmark_with_repeated_ids(spark):
    rng = random.Random(9)
    a, b = words(rng, 30), words(rng, 30)
    items = spark.createDataFrame([(1, a), (1, b), (1, b), (None, a), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"{words(rng, 9)} {a} {b}"), (10, words(rng, 50)), (None, b)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.similarity) for r in decontaminate.contaminated(docs, items).collect())
    assert got == sorted([("10", "1", 1.0)] * 3 + [("10", "None", 1.0)] + [("None", "1", 1.0)] * 2)


# Null and repeated keys


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return np.array([*Tokenizer.from_file(queries.tokenizer(name)).encode(text or "", add_special_tokens=False).ids, end], np.uint32)


def test_token_output_of_null_and_repeated_ids(spark):
    texts = [(7, "seven words"), (7, "seven again"), (None, "no id"), (None, None), (1, ""), (7, "seven words")]
    rows = [(k, t, "l", 1, 2) for k, t in texts]
    got = token_output(spark.createDataFrame(rows, DOCS).repartition(3), queries.tokenizer("byte_bpe_50k.json")).collect()
    assert len(got) == len(rows)
    made = {(str(k), len(i), zlib.crc32(i.tobytes())) for k, t in texts for i in [ids_of("byte_bpe_50k.json", t, 2)]}
    assert {(str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got} == made
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.concatenate(([0], np.cumsum([r.n_tokens for r in order])[:-1])).tolist()
    assert [r.doc_id for r in order if r.doc_id is not None] == [1, 7, 7, 7]


def test_packing_of_null_and_repeated_ids(spark):
    texts = [(7, "seven words"), (7, "seven words"), (None, "no id"), (None, None), (7, "other")]
    got = best_fit_packing(spark.createDataFrame([(k, t, "l", 1, 2) for k, t in texts], DOCS), queries.tokenizer("word_bpe_49k.json")).collect()
    want = Counter((str(k), len(i), zlib.crc32(i.tobytes())) for k, t in texts for i in [ids_of("word_bpe_49k.json", t, 1)])
    assert Counter((str(r.doc_id), r.length, r.ids_crc32) for r in got) == want
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert len({p[:2] for p in places}) == len(places)


def test_chat_of_null_keys(spark):
    rows = [(None, 1, "user", "q"), (None, None, "system", "s"), (None, 2, "assistant", "a"), (3, None, "assistant", "x"), (3, None, "assistant", "x")]
    got = {r.conv_id: r for r in read_windows(chat_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    said = {None: [("system", "s"), ("user", "q"), ("assistant", "a")], 3: [("assistant", "x")] * 2}
    for key, turns in said.items():
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[key].n_turns == len(turns) and got[key].loss_sha256 == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()


def traced(work):
    """(result, bytes allocated at most)."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_one_large_group_of_contexts_is_sorted_in_little_memory():
    rng = np.random.default_rng(5)
    n = 4000
    contexts = np.tile(rng.integers(97, 100, 350).astype(np.uint8), (n, 1))
    contexts[np.arange(n), rng.integers(0, 150, n)] = 32
    (who, start, end), most = traced(lambda: suffix_dedup.repeated_spans(contexts.ravel(), np.arange(1, n + 1) * 350, np.full(n, 150), np.zeros(n, np.int64), 200, 50))
    assert len(who) == n and (start >= -150).all() and (end <= 200).all()
    assert most < 40 * contexts.size


def test_bytes_kept_of_long_texts_in_little_memory():
    size = 1 << 20
    keep, most = traced(lambda: suffix_dedup.kept_bytes(np.array([0, size]), np.zeros(2, np.int64), np.array([5, size - 9]), np.array([8, size + 50])))
    assert np.flatnonzero(~keep).tolist() == [5, 6, 7, *range(size - 9, size)]
    assert most < 8 * size


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_at_text_and_line_ends_are_the_librarys(name):
    cache = tokens.TokenCache(queries.tokenizer(name))
    texts = ["Ab", "ab\ncd", "ab,\ncd.", "é\nÜber!\nx's 's\n's\n12 a1\n(ab)", "ab'll\nit's", "\nab", "ab\n", "...\n...", "\x01ab\n\u01c5", "a\x00b \x00c", "中\n文 a"]
    library = [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert cache.encode(texts) == library
    if not cache.drops_space:  # words go to the model, not through the whole tokenizer
        cache._ids = None
        assert cache._learn("\nWord") and cache._learn("\0Word")


def test_a_larger_cache_asks_the_library_once():
    from pairlens.llm import token_output

    path = queries.tokenizer("byte_bpe_50k.json")
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace() and c not in (10, 32)]
    texts = [f"wörd{c}a{i}, next" for i, c in enumerate(spaces)] + [" ".join(f"{a}{b}ord" for a in "abcdefgh") for b in "abcdefgh"] + ["one\ntwo three"]
    asked = {}
    for entries in (5, 2000):
        cache = tokens.TokenCache(path, entries)
        learn, seen = cache._learn, []
        cache.known.learn = lambda piece, learn=learn, seen=seen: seen.append(piece) or learn(piece)
        for _ in range(3):
            got = [cache.encode([t])[0] for t in texts]
        assert got == [np.array(cache.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        asked[entries] = seen
    assert len(asked[2000]) == len(set(asked[2000])) < len(asked[5])
    assert token_output.PIECES > tokens.CACHE_ENTRIES


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_column_has_the_librarys_ids(name):
    cache = tokens.TokenCache(queries.tokenizer(name), 20)
    odd = [None, "", "Ab, ab,\nAb.", "a  b", " a", "a\n", "a\n\nb", "a\tb", "a\x00b", "x <|endoftext|> y", "a b"]
    marks = ["it's, 'tis it'll'd", "é, ×, ÷. Ǆ! ɏ; é, ª: 中文, a1. 1a, a.b,c's", "(a) [é] a--b é%%% ,\n.\n1", "'s\n's, a\n'll"]
    column = pa.array(["before", *odd, *marks, *odd]).slice(1)
    library = [cache.tokenizer.encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()]
    for some in (slice(None), slice(0, 0), slice(0, 1), slice(11, 15)):
        ids, counts = cache.encode_column(column[some])
        assert counts.tolist() == [len(x) for x in library[some]] and ids.tolist() == sum(library[some], [])


def test_words_of_a_column_are_looked_up_and_learned_once():
    cache = tokens.TokenCache(queries.tokenizer("byte_bpe_50k.json"))
    learn, learned = cache.parts.learn, []
    cache.parts.learn = lambda part: learned.append(part) or learn(part)
    column = pa.array(["Word wörd, word\nWord wörd.", "Word, word wörd! word."] * 50)
    ids, counts = cache.encode_column(column)
    assert sorted(learned) == sorted(["Word", " wörd", ",", " word", "\n", ".", "!"])  # a word with marks is not another word
    assert len(ids) == counts.sum()


def test_shards_close_at_the_document_that_fills_them(spark):
    from pairlens.llm.token_output import Shard, write_shards

    rows = [(i, "a b c" if i % 3 else None if i % 2 else " ".join("ab" * 9), "l", 1, 2) for i in range(40)]
    lengths = [len(ids_of("byte_bpe_50k.json", r[1], 2)) for r in rows]
    shards = write_shards(spark.createDataFrame(rows, DOCS), queries.tokenizer("byte_bpe_50k.json"), 2, shard_tokens=20).orderBy("part", "seq").collect()
    assert [k for s in shards for k in s.doc_ids] == list(range(40))
    for s, after in zip(shards, [*shards[1:], None]):
        mine = [lengths[k] for k in s.doc_ids]
        assert Shard(s.shard).doc_lengths.tolist() == mine and s.n_tokens == sum(mine) and sum(mine[:-1]) < 20
        assert sum(mine) >= 20 or after is None or after.part != s.part

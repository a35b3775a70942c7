"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayfold.llm import collocation, line_dedup, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string"


def one_edit(a, b):
    """By all edits, not by places."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_words(words, times=2):
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v))
        if words[best] >= times * words[w]:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def variants(df, **kw):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **kw).collect()}


@pytest.mark.parametrize("limit,seed", [(2, 1), (5, 2), (48, 3)])
def test_op11_against_all_pairs(spark, limit, seed):
    """Few letters, so that blocks are large and places are ambiguous; words of 1 to 90 letters."""
    draw = random.Random(seed)
    words = {"".join(draw.choice("abÿ") for _ in range(draw.choice((1, 2, 5, 6, 7)))) for _ in range(300)}
    long = ["ab" * 40 + "x", "ab" * 40, "ab" * 39 + "xb", "b" + "ab" * 40, "a" * 63, "a" * 64, "a" * 65, "a" * 66]
    counts = {w: draw.choice((3, 6, 7, 14, 50)) for w in [*words, *long]}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"), limit=limit)
    assert got == near_words(counts)


def test_op11_many_words_of_one_beginning(spark):
    """A hub with thousands of words that share half of it: blocks are subdivided, no link is lost."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    counts = {"commonly": 1000} | {f"comm{a}{b}{c}y": 3 for a in letters[:9] for b in letters for c in letters[:12]}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    by_rest = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_rest[i, w[:i] + w[i + 1 :]].add(w)
    near = Counter()
    for w in counts:
        near[w] = len({v for i in range(len(w)) for v in by_rest[i, w[:i] + w[i + 1 :]]} - {w})
    assert {w: x[3] for w, x in got.items()} == dict(near)


def test_op11_long_chain_of_forms(spark):
    """Each word's form is the next one: pointers are followed to the end."""
    words = ["x" * i + "y" * (40 - i) for i in range(13)]
    counts = {w: 3 * 2**i for i, w in enumerate(words)}
    got = variants(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert {x[1] for x in got.values()} == {words[-1]} and got == near_words(counts)


def test_op11_counts_drop_letters_by_check_sum(spark, odd_docs, no_docs):
    rows = [(i, "Straße NAÏVE teh teh the÷ words, wordz x" * 3, None) for i in range(60)] + [(None, "words words Words", "en"), (1, None, None)]
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, DOCS), typo_every=7).collect()}
    want = Counter()
    for i, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 7 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] += len(w) >= 5
    assert got == {w: n for w, n in want.items() if n >= 3}
    assert spelling.variants(spelling.word_counts(odd_docs, min_count=1)).count() == spelling.word_counts(odd_docs, min_count=1).count() == 5
    assert spelling.variants(spelling.word_counts(no_docs)).count() == 0


def collocations(rows, least, top=2000, longest=5):
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in found.items():
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), b in found.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    return {(lang, i, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1)}


@pytest.mark.parametrize("block_words,seed", [(30, 1), (500, 2), (4_000_000, 3)])
def test_op12_against_all_phrases(spark, block_words, seed):
    draw = random.Random(seed)
    vocab = ["a", "B", "cc", "é", "漢", "d#"]
    rows = [(i, "".join(draw.choice(vocab) + draw.choice((" ", " ", " ", "\t ", ", ", ".\n", "?x ", "\r")) for _ in range(draw.randrange(40))), draw.choice(("en", None, "und"))) for i in range(150)]
    rows += [(500 + i, "the same passage in many texts of all", "en") for i in range(20)] + [(900, None, "en"), (901, "", None), (902, " . . ", "de")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {tuple(r) for r in collocation.top(collocation.mined(docs, min_count=9, block_words=block_words)).collect()}
    assert got == collocations(rows, 9) and len(got) > 60


def test_op12_many_buckets_and_names_of_many_languages(spark):
    """As many buckets as characters: most hold one word or pair, or none."""
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice("abcdef") for _ in range(30)), draw.choice(("en", "de", "fr", "x" * 50))) for i in range(80)]
    tables, n = collocation.phrases(spark.createDataFrame(rows, DOCS), min_count=5, block_words=200, bucket_chars=1)
    words = Counter((lang, w) for _, text, lang in rows for w in text.split())
    assert {(r.lang, r.word): r.f for r in tables[0].collect()} == {k: v for k, v in words.items() if v >= 5}
    pairs = Counter((lang, *p) for _, text, lang in rows for p in zip(text.split(), text.split()[1:]))
    assert sorted(r.f for r in tables[1].collect()) == sorted(v for v in pairs.values() if v >= 5)
    assert {r.lang: r.n for r in n.collect()} == dict(Counter(lang for lang, _ in words.elements()))
    names = [r.name for t in tables[:1] for r in t.collect()]
    assert len(names) == len(set(names))


def test_op12_gives_its_disk_back(spark):
    """What is left is what the result reads: named phrases and counts, no lists of where names are and no shuffle files."""
    from wayfold.llm.common import checkpoint_dir

    folder = checkpoint_dir(spark).removeprefix("file:")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()
    shuffles = lambda: {f for d, _, fs in os.walk(local) for f in fs if re.fullmatch(r"shuffle_.*\.data", f)}
    cuts, files = {d for d in os.listdir(folder) if d.startswith("cut-")}, shuffles()
    rows = [(i, "the same words again and again, and some more", "en") for i in range(40)]
    tables, n = collocation.phrases(spark.createDataFrame(rows, DOCS), min_count=5, block_words=50)
    left = {d: set(spark.read.parquet(f"{folder}/{d}").columns) for d in os.listdir(folder) if d.startswith("cut-") and d not in cuts}
    assert len(left) == 1 + len(tables) and not any(c & {"at", "names", "codes"} for c in left.values())
    for _ in range(50):
        if not (new := shuffles() - files):
            break
        time.sleep(0.2)
    assert not new


def test_op12_first_of_each_language(spark):
    rows = [(i, "a b c d e f g h i j k l m n o p", lang) for i in range(3) for lang in ("en", "de")]
    docs = spark.createDataFrame([*rows, *[(9, f"{x} {y}", "en") for x in "abc" for y in "defg" for _ in range(3)]], DOCS)
    got = {tuple(r) for r in collocation.top(collocation.mined(docs, min_count=3), n=5).collect()}
    assert got == collocations([tuple(r) for r in docs.collect()], 3, top=5) and len(got) == 10


def test_op12_scores_past_64_bits(spark):
    """The cut's products are decimals of 38 digits."""
    big = spark.createDataFrame([(["x", "y"], [10**12, 10**11], [3 * 10**12, 10**11], 10**11, 10**15)], "words array<string>, starts array<long>, ends array<long>, f long, n long")
    c = big.select(F.expr(collocation._CUT).alias("c")).first().c
    assert (c.score, c.k, c.l, c.r) == (1000 * 10**11 * 10**15 // (10**12 * 3 * 10**12), 1, 10**12, 3 * 10**12)


def test_op12_odd_rows_and_long_texts(spark, odd_docs, no_docs):
    assert collocation.mined(odd_docs, min_count=2).count() > 0
    assert collocation.mined(no_docs).count() == 0
    assert collocation.mined(spark.createDataFrame([(1, ".,;\n" * 3000, "en"), (2, "a", "en")], DOCS), min_count=1, block_words=100).count() == 0  # blocks without a word
    text = "so and so. " * 2_000_000  # in parts, by pieces
    rows = collocation.mined(spark.createDataFrame([(1, text, "en")], DOCS)).collect()
    assert [(r.words, r.a, r.n) for r in rows] == [(["so", "and", "so"], 2_000_000, 6_000_000)]


def deduped(rows, min_chars, min_docs):
    key = lambda line: line.strip(BLANKS).translate(LOW)
    holders = defaultdict(set)
    for n, (i, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            holders[key(line)].add((i is not None, i or 0, n))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or max(holders[key(x)])[:2] == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def drawn_lines(seed):
    draw = random.Random(seed)
    lines = [draw.choice(("", " ", "\t")) + draw.choice(("line", "LINE", "É")) + str(draw.randrange(12)) + draw.choice(("", "\r", " \x0b")) for _ in range(60)] + ["", "x"]
    ids = [*range(40), None, None, 7, 39]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randrange(6)))) for i in ids]
    return [*rows, (50, None), (None, None), (51, ""), *[(i, "everywhere") for i in range(60, 90)]]


@pytest.mark.parametrize("batches,heavy,seed", [(1, 10_000, 1), (4, 10_000, 2), (5, 3, 3), (7, 10_000, 4)])
def test_op13_against_all_lines(spark, monkeypatch, batches, heavy, seed):
    """heavy: with few keys allowed to be broadcast, the join takes most; with many, none."""
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rows = drawn_lines(seed)
    out = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=4, min_docs=5, batches=batches)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=str)
    assert got == deduped(rows, 4, 5) and sum(x[2] for x in got) > 30


@pytest.mark.parametrize("order", [1, -1])
def test_op13_runs_take_batches_in_any_order(spark, order):
    """Levels are compacted as runs come, and the largest document of a line is known in the end."""
    rows = [(i, t) for i, t in drawn_lines(5) if i is not None]
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[line.strip(BLANKS).translate(LOW)].add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, min_chars=4, min_docs=5, fanout=3)
    for part in range(7)[::order]:
        runs.add(docs.where(F.col("doc_id") % 7 == part))
        assert all(len(level) < 3 for level in runs.levels)
    shared = runs.shared().collect()
    assert len(runs.runs) == 1
    assert sorted(r.last for r in shared) == sorted(max(ids) for k, ids in holders.items() if len(k) >= 4 and len(ids) >= 5)
    assert all(5 <= r.docs for r in shared)
    runs.close()
    assert runs.runs == []


def test_op13_settled_lines_add_nothing_to_the_runs(spark):
    docs = spark.createDataFrame([(i, "a line that is everywhere\n" + f"a line of document {i} alone") for i in range(30)], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, min_chars=4, min_docs=5, fanout=9)
    sizes = []
    for low in (20, 10, 0):
        runs.add(docs.where((F.col("doc_id") >= low) & (F.col("doc_id") < low + 10)))
        sizes.append(spark.table(runs.levels[0][-1]).count())
    assert sizes[0] == 11 and sizes[1:] == [10, 10] or runs.heavy(500) <= 10
    runs.close()


def test_op13_odd_rows_clashing_names_and_long_texts(spark, odd_docs, no_docs):
    docs = odd_docs.withColumns({c: F.lit(5) for c in ("row", "r", "gone", "lines", "line", "pos", "r1", "K1", "last", "docs", "N_Lines")})
    out = line_dedup.dedup(docs)
    assert out.count() == docs.count() and out.where("k1 <> 5 or gone <> 5 or row <> 5").count() == 0
    assert line_dedup.dedup(no_docs).count() == 0
    text = "\n".join(f"a line of a very long text that is shared by some {i % 100_000}" for i in range(300_000))
    rows = line_dedup.dedup(spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("h")).collect()
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in rows} == {(i, 300_000, 300_000 if i < 4 else 0) for i in range(5)}
    assert {r.h for r in rows if r.doc_id == 4} == {hashlib.sha256(text.encode()).hexdigest()}

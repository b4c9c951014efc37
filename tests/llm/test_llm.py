"""The training-data operators against brute force on small tables, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import decontaminate as dec
from pagemill.llm import licenses, lm_scoring, mixing, pii, quality_crf, quality_rules, queries, similarity_join, token_counts, warc
from pagemill.llm.components import components

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa Straße ÉCOLE mü 日本 a1 b2".split()
LONG = " ".join(WORDS[i % 16] + str(i % 97) for i in range(30_000))


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Texts with nulls, empties, repeats, near copies, junk, a very long text, and ties."""
    r = random.Random(5)
    texts = [None, "", " \n\t", "one", "one", "a b c d", LONG]
    for _ in range(40):
        t = prose(r, r.randint(5, 120))
        texts += [t, t] if r.random() < 0.3 else [t]
        if r.random() < 0.5:
            ws = t.split()
            ws[r.randrange(len(ws))] = "changed"
            texts.append(" ".join(ws))
    texts += ["line one\nline one\nline one\n" * 4, "### $$$ | x % y " * 9, "a@b.co 1.2.3.4 t +1 (555) 010-2345 c 4539578763621486 i GB82 WEST 1234 5698 7654 32"]
    return [(i, t, "en", r.choice(["s0", "s0", "s1", None]), len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df):
    """Columns with names that the operators use themselves."""
    plain = ("n_words", "size", "copies", "copy", "set", "id", "token", "root", "n", "score", "target", "words", "label", "a.b", "block")
    inner = ("rules", "rules_counts", "hits", "hits_part", "spans", "redacted", "licenses", "licenses_words", "mix", "__label", "__key", "__size", "__src", "__row", "__n")
    return df.withColumns({c: F.lit(7) for c in plain + inner})


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    mine, theirs = (d[columns].sort_values(columns).reset_index(drop=True) for d in (mine, theirs))
    assert len(mine) == len(theirs) and ((mine == theirs) | (mine.isna() & theirs.isna())).all().all()


# 1


def brute_counts(t):
    t = t or ""
    w, lines, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rules_counts(rows):
    for _, t, *_ in rows:
        assert quality_rules.text_counts((t or "").encode())[:5] == brute_counts(t)


def test_rules_learn_and_order():
    r = np.random.default_rng(0)
    x = r.random((3000, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] <= 0.1) & (x[:, 2] > 0.5))
    rules = quality_rules.learn_rules(x, bad)
    said = np.zeros(len(x), bool)
    for rule in rules:
        said |= quality_rules.covered(rule, x)
    assert (said == bad).mean() > 0.98
    assert quality_rules.learn_rules(x, np.zeros(3000, bool)) == [] and quality_rules.learn_rules(x[:0], bad[:0]) == []


def test_rules_chain_equals_numpy(spark, docs):
    rules = [[quality_rules.Test(0, True, 50.0), quality_rules.Test(2, False, 0.1)], [quality_rules.Test(2, True, 0.5)]]
    made = quality_rules.judged(docs, rules)
    features = quality_rules.features("rules.counts")
    found = made.select(*[c.alias(k) for k, c in features.items()], quality_rules.verdict(rules, features).alias("k"), F.col("rules.kept").alias("kept"), F.col("rules.base_failed").alias("failed")).toPandas()
    assert (found.kept == (found.k & ~found.failed)).all()
    found = found.drop(columns=["kept", "failed"])
    x = found.drop(columns="k").to_numpy()
    assert (found.k.to_numpy() == ~(quality_rules.covered(rules[0], x) | quality_rules.covered(rules[1], x))).all()


def test_rules_cases(spark, docs, none):
    kept = quality_rules.keep_good(clashing(docs), [])
    assert kept.columns == clashing(docs).columns and kept.where("rules = 7 and rules_counts = 7 and __n = 7").count() == kept.count()
    assert quality_rules.keep_good(none, []).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.fit(docs, labels) == []
    twice = spark.createDataFrame([(7, 1), (7, 0), (7, None), (None, 0), (8, 1), (8, 1)], "doc_id long, quality int")
    assert quality_rules.fit(clashing(docs), twice) == []
    held = quality_rules.op1_quality_rules(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    assert held.where("kept = (quality = 1) or base_failed").count() >= 0.95 * held.count()


# 2


def brute_scores(rows, good):
    """Witten-Bell over add-one unigrams of all words, from plain dictionaries, each text's own counts left out."""
    split = [(key, lm_scoring.words_of((t or "").encode())) for key, t in rows]
    vocabulary = {w for _, ws in split for w in ws}
    for mine, (key, ws) in enumerate(split):
        means = []
        for target in (True, False):
            pairs = Counter(p for k, (other, vs) in enumerate(split) if k != mine and (other in good) == target for p in zip([None, *vs], vs))
            words, after, kinds = Counter(), Counter(), Counter(p for p, _ in pairs)
            for (p, c), n in pairs.items():
                words[c] += n
                after[p] += n
            total = sum(words.values()) + len(vocabulary) + 2
            bits = [-np.log2((pairs[p, c] + max(kinds[p], 1) * (words[c] + 1) / total) / (after[p] + max(kinds[p], 1))) for p, c in zip([None, *ws], ws)]
            means.append(np.mean(bits) if bits else None)
        yield key, len(ws), means


@pytest.mark.parametrize("sizes", [(8 << 20, 32 << 20, 128 << 20), (9_000, 20_000, 50_000)])
def test_corpus_scores(spark, rows, docs, none, monkeypatch, sizes):
    for name, size in zip(("BLOCK_BYTES", "PAIR_SHARD_BYTES", "WORD_SHARD_BYTES"), sizes):
        monkeypatch.setattr(lm_scoring, name, size)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(3, None), (None, 1), (5, 1)], "doc_id int, quality int")
    again = [(5, "one more text"), (None, "a text without an id")]
    both = clashing(docs).select("doc_id", "text", "size").union(spark.createDataFrame([(*x, 7) for x in again], "doc_id long, text string, size int"))
    found = sorted(map(str, ((r.doc_id, r.n_tokens, *(x and round(x, 6) for x in (r.target_bits, r.background_bits, r.difference))) for r in lm_scoring.corpus_scores(both, labels).collect())))
    want = brute_scores([r[:2] for r in rows] + again, {i for i in range(1, 60, 2)})
    assert found == sorted(map(str, ((key, n, *(x and round(float(x), 6) for x in (t, b, b and t - b))) for key, n, (t, b) in want)))
    assert lm_scoring.corpus_scores(none, labels).count() == 0
    assert lm_scoring.corpus_scores(docs, labels.limit(0)).where("n_tokens > 0 and target_bits is null").count() == 0


def test_corpus_scores_of_text_ids(spark, monkeypatch):
    """Ids with line breaks, empty ids and many null ones leave their own counts out like any others."""
    for name, size in zip(("BLOCK_BYTES", "PAIR_SHARD_BYTES", "WORD_SHARD_BYTES"), (300, 900, 900)):
        monkeypatch.setattr(lm_scoring, name, size)
    texts = [f"common words and {'good' if i % 2 else 'bad'}{i // 2} words" for i in range(20)]
    for names in ([f"a{i}" for i in range(20)], [f"x\na{i}" for i in range(20)], ["", *(f"\n{i}" for i in range(19))], [None] * 5 + [f"{i}" for i in range(15)]):
        docs = spark.createDataFrame(list(zip(names, texts)), "doc_id string, text string")
        good = {n for i, n in enumerate(names) if i % 2 and n is not None}
        labels = spark.createDataFrame([(n, 1) for n in good], "doc_id string, quality int")
        found = sorted((str(r.doc_id), round(r.target_bits, 6), round(r.background_bits, 6)) for r in lm_scoring.corpus_scores(docs, labels).collect())
        assert found == sorted((str(key), round(float(t), 6), round(float(b), 6)) for key, _, (t, b) in brute_scores(list(zip(names, texts)), good))


def test_corpus_scores_tell_rare_words_apart(spark):
    """Beyond the 2,046 most frequent words too, those of the target score lower."""
    common = " ".join(f"w{i}" for i in range(3000))
    texts = [common, common, common] + [" ".join(f"{kind}{k}x{i}" for i in range(20)) for k in range(2) for kind in ("good", "bad") for _ in (0, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (7, 1)], "doc_id long, quality int")
    found = {r.doc_id: r.difference for r in lm_scoring.corpus_scores(docs, labels).collect()}
    assert max(found[i] for i in (3, 4, 7, 8)) < min(found[i] for i in (5, 6, 9, 10))


# 3


def brute_contamination(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = fold(text), set(), set()
    for name, body in items:
        v = fold(body)
        k = min(10, len(v))
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def brute_longest(text, items):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, best = fold(text), (0, None)
    starts = {}
    for i, x in enumerate(w):
        starts.setdefault(x, []).append(i)
    for name, body in items:
        v = fold(body)
        least = min(10, len(v))
        for j in range(len(v) - least + 1 if v else 0):
            for i in starts.get(v[j], ()):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n >= least and (n > best[0] or n == best[0] and i < best[1]):
                    best = (n, i)
    return best


@pytest.mark.parametrize("block, shard", [(1 << 20, 1 << 20), (60, 300)])
def test_decontamination(spark, rows, docs, monkeypatch, block, shard):
    r = random.Random(8)
    texts = [t for _, t, *_ in rows if t]
    cut = lambda t: " ".join(t.split()[(a := r.randrange(len(t.split()) or 1)) : a + r.randint(1, 30)])
    items = [(i, cut(r.choice(texts))) for i in range(25)] + [(90, "one"), (91, ""), (92, None), (93, "No Such Thing here"), (5, "beta gamma"), (10, LONG[50_000:50_900])]
    monkeypatch.setattr(dec, "SHARD_BYTES", shard)
    monkeypatch.setattr(dec.blocks, "__defaults__", (block,))
    benchmark = spark.createDataFrame(items + [(None, "alpha")], "item_id long, text string")
    found = {x.doc_id: x for x in dec.removed_report(clashing(docs), benchmark).collect()}
    for i, t, *_ in rows:
        assert (found[i].n_words, found[i].n_hit, found[i]["items"]) == brute_contamination(t, items), i
    for i, t, *_ in rows:
        assert (found[i].longest, found[i].longest_start) == brute_longest(t, items), i
    kept = dec.remove_contaminated(clashing(docs), benchmark)
    assert kept.columns == clashing(docs).columns and kept.where("hits = 7 and hits_part = 7").count() == kept.count()
    assert {x.doc_id for x in kept.collect()} == {i for i, x in found.items() if not x.contaminated}


def test_longest_matches(spark):
    text = "x x " + " ".join(f"w{i}" for i in range(30)) + " y"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(5, 25)))], "item_id string, text string")
    assert [tuple(r) for r in dec.matches(docs, items).collect()] == [(1, "q", 0, 7, 20)]


def test_decontamination_empty(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dec.remove_contaminated(docs, bench).count() == docs.count()
    assert dec.remove_contaminated(none, spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_suffix_array_order():
    words = np.array([2, 1, 2, 1, 2, 0], np.int32)
    order = dec.SuffixArray.build(words, 16).order.tolist()
    assert order == sorted(range(6), key=lambda i: words[i:].tolist())


# 4

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x - 9 * (x > 9) for x in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))) % 10 == 0


def brute_spans(t):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_pii(spark, docs):
    r = random.Random(3)
    parts = ["1", "2", "0", "255", ".", ".", "@", "+1", "-", " ", "(", ")", "a", "é", "🙂", "%", "4539578763621486", "a@b.c", "_", "12 34"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "9" * 3000, "1." * 2000, "a." * 900 + "@" + "b." * 900 + "c", "+1" + "(" * 900, "1 " * 900, "text " * 9000 + "x@y.zz"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found = df.select("text", F.transform(F.filter(pii.spans(F.col("text")), lambda s: s["kind"].isin(*pii.BASE)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])).alias("s"))
    for row in found.collect():
        assert row.s == brute_spans(row.text), row.text[:80]


def test_pii_method_and_redaction(spark, docs, none):
    one = lambda t: [(s.kind, s.start, s.end, round(s.score, 1)) for s in spark.createDataFrame([(t,)], "t string").select(pii.spans(F.col("t")).alias("s")).first().s]
    assert one("IBAN GB82 WEST 1234 5698 7654 32") == [("iban", 5, 32, 0.9)]
    assert one("GB82 WEST 1234 5698 7654 33") == [] and one("card 4539578763621486")[0][3] > one("4539578763621486")[0][3]
    assert one("IBAN AT61 1904 3002 3457 3201 PLEASE") == [("iban", 5, 29, 0.9)] and one("AT61 1904 3002 3457 320") == []
    assert one("sample: AT61 1904 3002 3457 3201") == [] and one("an example account AT61 1904 3002 3457 3201") == []
    assert one("SSN 123-45-6789") == [("ssn", 4, 15, 0.7)] and one("part 123-45-6789") == [] and one("SSN 666-45-6789") == []
    assert one("NHS number 943 476 5919")[0][0] == "nhs" and one("call 943 476 5919") == [] and one("NHS number 943 476 5918") == []
    assert [k for k, *_ in one("ssn a@b.co 123-45-6789")] == ["email", "ssn"]  # context beyond a neighbouring match
    clean = pii.redact(clashing(docs), chars="n_chars")
    assert clean.columns == clashing(docs).columns and clean.where("spans = 7 and redacted = 7").count() == docs.count()
    last = clean.orderBy(F.desc("doc_id")).first()
    assert last.text == "[EMAIL] [IP] t [PHONE] c [CARD] i [IBAN]" and last.n_chars == len(last.text)
    assert clean.where("doc_id = 0").first().text is None and pii.redact(none).count() == 0


# 5


def test_licenses(spark, docs):
    r = random.Random(4)
    parts = "gnu general public license apache LICENSE cc by CC-BY mit Mit, . é x".split()
    texts = [None, "", "cc by " * 2000] + [" ".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += [f"foo bar {t.text.title()}, end." for t in licenses.TEMPLATES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = licenses.with_licenses(clashing(df), into="found")
    assert made.columns == [*clashing(df).columns, "found"] and made.where("licenses_words = 7").count() == len(texts)
    found = made.select("doc_id", "found.*").orderBy("doc_id").collect()
    for row, t in zip(found, texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, l) for i in range(len(w)) for p, l in licenses.PHRASES.items() if w[i : i + len(p.split())] == p.split()]
        assert row["words"] == len(w) and [tuple(p) for p in row["places"]] == places
        assert [(x.label, x.start, round(x.share, 6)) for x in row["templates"]] == brute_templates(w)
    for row, t in zip(found[-len(licenses.TEMPLATES) :], licenses.TEMPLATES):
        assert (t.label, 2) in [(x.label, x.start) for x in row["templates"]]


def brute_templates(w):
    """Starts of each template in ascending order, cut where they are more than SLACK apart."""
    follows = lambda low, high, p: any(w[i : i + len(p.split())] == p.split() for i in range(max(low, 0), high + 1))
    out = []
    for k, t in enumerate(licenses.TEMPLATES):
        at = {x: p for x, ps in licenses.INDEX.items() for j, p in ps if j == k}
        runs = []
        for start, p in sorted((i - at[x], at[x]) for i, x in enumerate(w) if x in at):
            if runs and start - runs[-1][-1][0] <= licenses.SLACK:
                runs[-1].append((start, p))
            else:
                runs.append([(start, p)])
        ws, key = t.text.split(), t.key.split()
        offset = next(i for i in range(len(ws)) if ws[i : i + len(key)] == key)
        for run in runs:
            n = len({p for _, p in run})
            low, high = run[0][0] + offset - licenses.SLACK, run[-1][0] + offset + licenses.SLACK
            if n >= 0.6 * len(at) and follows(low, high, t.key) and not any(follows(low, high, p) for p in t.excluded):
                out.append((t.label, run[0][0], round(n / len(at), 6)))
    return out


def test_license_method(spark, none):
    by = {t.label: t for t in licenses.TEMPLATES}
    r = random.Random(11)
    noisy = by["mit"].text.split()
    for k in (12, 40, 70, 100):
        noisy[k:k] = ["extra"] * r.randint(1, 3)
    texts = [
        "Copyright 2020 A. B.\n\n" + " ".join(noisy), by["cc-by"].text, by["cc-by-sa"].text.replace("sharealike", "ShareAlike"), by["agpl"].text,
        "filler " * 20_000 + by["bsd"].text, by["apache"].text, by["apache"].text, " ".join(by["mit"].text.split()[::-1]),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [sorted({x.label for x in row.found.templates}) for row in licenses.with_licenses(df, into="found").orderBy("doc_id").collect()]
    assert found == [["mit"], ["cc-by"], ["cc-by-sa"], ["agpl"], ["bsd"], ["apache"], ["apache"], []]
    assert licenses.with_licenses(none).count() == 0


# 6


def brute_groups(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 80 * (len(sets[i]) + len(sets[j]) - o):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


SMALL = similarity_join.Sizes(block=9_000, shard=20_000, forest=50_000, leaves=4, first=1, fanout=2, pairs=16)


def check_groups(spark, texts, sizes=similarity_join.SIZES):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = similarity_join.near_copy_components(clashing(df), sizes=sizes).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in found] == brute_groups(texts)


@pytest.mark.parametrize("sizes", [similarity_join.SIZES, SMALL])
def test_similarity_join(spark, rows, sizes):
    check_groups(spark, [t for _, t, *_ in rows], sizes)


@pytest.mark.parametrize("seed", [6, 7])
def test_similarity_join_large_trees(spark, seed):
    """More leaves under a token than a part holds, copies at both sides of the threshold, and sizes at its ends."""
    r = random.Random(seed)
    base = prose(r, 60).split()
    texts = []
    for k in range(40):
        ws = list(base)
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(60)] = f"n{k}"
        texts.append(" ".join(ws[: r.choice([60, 60, 60, 52, 49, 48])]))
    texts += [" ".join(base[:30]) + " " + prose(r, 40) for _ in range(8)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "x y", "x y", "x"]
    r.shuffle(texts)
    check_groups(spark, texts, SMALL)


def test_forest_against_all_pairs():
    """One task's trees link what all pairs under their tokens link, whatever is known before."""
    import pyarrow as pa

    r = np.random.default_rng(3)
    pool = np.sort(r.integers(0, 2**64 - 1, 4000, dtype=np.uint64))
    sets = []
    for _ in range(60):
        base = r.choice(pool, r.integers(4, 120), replace=False)
        for _ in range(r.integers(1, 6)):
            own = base.copy()
            own[r.random(len(base)) < 0.06] = r.choice(pool, 1)
            sets.append(np.unique(own))
    tokens = r.integers(0, 3, len(sets))
    alike = lambda a, b: 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if tokens[i] == tokens[j] and alike(sets[i], sets[j])]
    root = list(range(len(sets)))
    for i, j in pairs[:7]:
        root = [min(root[i], root[j]) if x in (root[i], root[j]) else x for x in root]
    n = [len(s) for s in sets]
    rows = pa.table({"token": tokens, "i": [0] * len(sets), "j": [0] * len(sets), "id": range(len(sets)), "n": n, "root": root, "reach": [5 * x // 4 for x in n], "s0": n})
    whole = pa.table({"leaf": range(len(sets)), "hash": n, "set": [s.tobytes() for s in sets]})
    found = similarity_join.forest_links(rows, whole, SMALL).to_pylist()
    want = list(root)
    for i, j in pairs:
        want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    up = {x["a"]: x["b"] for x in found}
    assert [up.get(x, x) for x in root] == want and len(pairs) > 50


def test_similarity_join_repeated_ids(spark):
    """Repeated rows are one leaf; rows of one id with several texts are one node."""
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, one), (1, one), (1, two), (2, one + " z"), (3, two + " z"), (4, "other text of five words")]
    found = similarity_join.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 4)]


def test_similarity_join_ids_between_texts(spark):
    """An id links the classes of its texts where it is the smallest of none or only one."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(5, one), (7, one), (7, two), (9, two + " z"), (3, three), (8, three), (8, two), (11, "other text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = similarity_join.near_copy_components(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (5, 3), (7, 3), (7, 3), (8, 3), (8, 3), (9, 3), (11, 11)]
    assert sorted(r.doc_id for r in similarity_join.drop_near_copies(docs).collect()) == [3, 11]


def test_drop_near_copies(spark, docs, none):
    odd = docs.union(spark.createDataFrame([(None, "one", None, None, None), (3, "one", "en", "s0", 3)], SCHEMA))
    kept = similarity_join.drop_near_copies(clashing(odd))
    assert kept.columns == clashing(docs).columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(3) == 1 and 4 not in ids and ids.count(None) == 1 and {0, 1, 2} <= set(ids)
    assert similarity_join.drop_near_copies(none).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {(r.node, r.root) for r in components(links).collect()} == {(i, 1) for i in range(2, 41)} | {(101, 100)}
    assert components(links.limit(0)).count() == 0


# 7


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é日🙂 WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n</p>\n" * 400
    pages = [(1, "u1\r\nX: y", big), (2, None, big), (3, "u3", None), (4, "u4", "small"), (5, "u5", "small"), (6, "u6", "\r\n\r\n" * 700), (7, "u7", big), (7, "u7", big), (None, "u8", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("data", F.lit(1))
    warc.write_warc(df.repartition(2), str(tmp_path / "w"), chunk=1000)
    chunks = warc.read_warc(spark, str(tmp_path / "w"), 1000)
    found = chunks.orderBy("record_id", "chunk_no").collect()
    assert all(r.chunk_bytes <= 1000 for r in found) and all(r.payload_digest == r.stated_digest for r in found if r.last and r.record_type == "response")
    got = sorted((r.record_id, r.record_type, r.refers_to or "", r.payload_bytes, r.payload_digest) for r in warc.resolved(chunks).collect())
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = h == big and i in (1, 2)
        want.append((f"<urn:page:{'' if i is None else i}>", "revisit" if again else "response", "<urn:page:7>" if again else "", len(b), hashlib.sha1(b).hexdigest()))
    assert got == sorted(want)


def test_warc_reads_whole_records(spark, tmp_path):
    """Archives of others: no segments, plain bytes as payload, several members in a file."""
    import gzip

    body = b"\x00\xff\r\n\r\nabc" * 500
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record.replace(b"urn:x", b"urn:y")))
    rows = warc.read_warc(spark, str(tmp_path), 700).where("last").orderBy("record_id").collect()
    assert [(r.record_id, r.payload_bytes, r.payload_digest) for r in rows] == [(u, len(body), hashlib.sha1(body).hexdigest()) for u in ("<urn:x>", "<urn:y>")]


def test_warc_payload_and_broken_records(spark, tmp_path):
    """Payloads come back byte by byte; broken records are rows with an error, and reading goes on."""
    import gzip

    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%s>\r\nContent-Length: %s\r\n\r\n"
    body = bytes(range(256)) * 9 + b"\xf0\x9f\n\n"
    whole = lambda name: head % (name, str(len(body)).encode()) + body + b"\r\n\r\n"
    broken = head % (b"bad", b"many") + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole(b"one") + broken + whole(b"two")))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole(b"three") + (head % (b"cut", b"5000") + body)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nWARC-Record-ID: <urn:half>\r\nWARC-Type: resource"))
    (tmp_path / "plain.warc").write_bytes(whole(b"plain"))
    (tmp_path / "empty.warc.gz").write_bytes(gzip.compress(b""))
    long = b"z" * 3_000_000  # one line
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(head % (b"long", str(len(long)).encode()) + long + b"\r\n\r\n"))
    chunks = warc.read_warc(spark, str(tmp_path), 1000)
    rows = {r.record_id: r for r in warc.resolved(chunks).collect()}
    assert {k: bool(r.error) for k, r in rows.items()} == {"<urn:one>": False, "<urn:two>": False, "<urn:three>": False, "<urn:long>": False, "<urn:bad>": True, "<urn:cut>": True, "<urn:half>": True}
    for name, want in (("one", body), ("two", body), ("cut", body), ("long", long)):
        own = chunks.where(F.col("record_id") == f"<urn:{name}>").orderBy("chunk_no").collect()
        assert b"".join(bytes(r.data) for r in own) == want and own[-1].payload_digest == hashlib.sha1(want).hexdigest() and max(r.chunk_bytes for r in own) <= 1000
    assert warc.read_warc(spark, str(tmp_path), 1000, payload=False).where("data is not null").count() == 0


def test_warc_names_other_files(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\n")
    with pytest.warns(UserWarning, match="a.warc"):
        assert warc.read_warc(spark, str(tmp_path)).count() == 0


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).count() == 0


# 8


def test_forward_backward():
    """Against all labellings of short chains."""
    r = np.random.default_rng(2)
    lengths = np.array([1, 4, 3])
    score = r.normal(size=8)
    good, both, total = quality_crf.forward_backward(score, lengths, (0.7, 0.4))
    at = 0
    for k, n in enumerate(lengths):
        s = score[at : at + n]
        weight, marginal, same = 0.0, np.zeros(n), np.zeros((n, 2))
        for bits in range(2**n):
            y = np.array([bits >> i & 1 for i in range(n)])
            pair = np.stack([(y[1:] == 0) & (y[:-1] == 0), (y[1:] == 1) & (y[:-1] == 1)], axis=1)
            w = np.exp((s * y).sum() + pair.sum(axis=0) @ np.array([0.7, 0.4]))
            weight += w
            marginal += w * y
            same[1:] += w * pair
        assert np.allclose(good[at : at + n], marginal / weight) and np.allclose(both[at : at + n], same / weight) and np.isclose(total[k], np.log(weight))
        at += n


def brute_line(line, lines, before):
    w, c = line.split(), len(re.sub(rb"[ \t-\r]", b"", line))
    n, d = max(len(w), 1), len(set(w))
    count = lambda p: len(re.findall(p, line))
    return [
        min(count(rb"[#*$%&|<>]") / n, 3) / 3, min(count(rb"[!?]") / n, 2) / 2, count(rb"[0-9]") / max(c, 1), count(rb"[A-Z]") / max(c, 1), 1 - d / n if len(w) > 7 else 0,
        min(lines.count(line) - 1, 3) / 3 if w else 0, 1 / (1 + len(w) / 8), min(c / n, 16) / 16, line.rstrip()[-1:] in (b".", b"!", b"?"), not w, len(set(w) & before) / max(d, 1),
    ]


def test_crf_score_from_weights(spark):
    """Features, marginals by all labellings, the weighted mean and the scale, redone line by line."""
    r = np.random.default_rng(5)
    model = quality_crf.Chain(r.normal(size=3 * len(quality_crf.NAMES) + 1), (0.6, 0.3), 0.45)
    texts = ["One line. # 12 A!", "a b c\n\nsame line here\nsame line here\nlast one?", None, "", "x\n" * 5, "WORDS words " * 9 + "\nand $ more | 7 <b>"]
    found = [x.score for x in quality_crf.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    for score, t in zip(found, texts):
        lines, seen, own = (t or "").encode().split(b"\n"), set(), []
        for line in lines:
            own.append(brute_line(line, lines, seen))
            seen |= set(line.split())
        none = [0.0] * len(own[0])
        s = [np.dot([*x, *(own[k - 1] if k else none), *(own[k + 1] if k + 1 < len(own) else none), 1], model.weights) for k, x in enumerate(own)]
        weight, good = 0.0, np.zeros(len(s))
        for bits in range(2 ** len(s)):
            y = [bits >> i & 1 for i in range(len(s))]
            w = np.exp(np.dot(s, y) + sum(model.stay[a] for a, b in zip(y, y[1:]) if a == b))
            weight, good = weight + w, good + w * np.array(y)
        size = np.array([len(x) + 1 for x in lines])
        mean = (good / weight) @ size / size.sum()
        assert np.isclose(score, 0.3 * mean / 0.45 if mean < 0.45 else 0.3 + 0.7 * (mean - 0.45) / 0.55), t


def test_crf_learns_beside_a_long_text(spark, monkeypatch):
    """A labelled text of more lines than are learned from is left out alone; repeats of an id are one row."""
    r = random.Random(4)
    texts = [(i, "\n".join(prose(r, 8) if i % 2 else "### $$$ |" for _ in range(4)), i % 2) for i in range(60) if i]
    docs = spark.createDataFrame([t[:2] for t in texts] + [(1000, "a line\n" * 3_000)] + [texts[0][:2]] * 200, "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in texts] + [(1000, 1)], "doc_id long, quality int")
    model = quality_crf.fit(docs, labels, lines=2_500)
    assert model is not None
    scores = {row.doc_id: row.score for row in quality_crf.scored(docs.where("doc_id < 1000").distinct(), model).collect()}
    assert min(scores[i] for i, _, q in texts if q) > max(scores[i] for i, _, q in texts if not q)


def test_rules_learn_one_row_an_id(spark, monkeypatch):
    """A repeated id is one row of what is learned from."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(3, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality_rules, "learn_rules", lambda x, bad: seen.append(len(x)) or [])
    assert quality_rules.fit(docs, labels) == [] and seen == [30]


def test_crf_long_texts(spark, docs):
    """Texts of many lines are learned from and scored; a bound on lines takes whole texts."""
    texts = [(i, ("good words stand here.\n" if i % 2 else "$$ ## !!\n") * 400, i % 2) for i in range(40)] + [(99, "x" * 300_000, 1)]
    df, labels = spark.createDataFrame(texts, "doc_id long, text string, quality int").drop("quality"), spark.createDataFrame([(i, q) for i, _, q in texts], "doc_id long, quality int")
    model = quality_crf.fit(clashing(df), labels)
    found = {x.doc_id: x.score for x in quality_crf.scored(df, model).collect()}
    assert all((found[i] >= 0.3) == bool(q) for i, _, q in texts[:-1]) and quality_crf.fit(df, labels, lines=500) is None


def test_crf_quality(spark, docs, none):
    found = quality_crf.op8_quality_crf(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    assert found.where("predicted = quality").count() >= 0.95 * found.count()
    model = quality_crf.Chain(np.zeros(3 * len(quality_crf.NAMES) + 1), (0.5, 0.2), 0.4)
    out = quality_crf.scored(clashing(docs), model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_crf.scored(none, model).count() == 0 and {r.score for r in quality_crf.scored(docs, None).collect()} == {0.5}


# 9


def test_mix(spark, docs, none, rows):
    made = mixing.with_copies(clashing(docs), into="m").collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    total = sum(sizes.values())
    names = sorted({s for s in source.values() if s}) + [None]
    own = {n: sum(v for i, v in sizes.items() if source[i] == n) for n in names}
    target, free = dict.fromkeys(names, 0.0), set(names)
    while True:  # share by weight, cap, and share the excess again
        left = total - sum(target[n] for n in names if n not in free)
        weights = sum(names.index(n) % 3 + 1 for n in free)
        over = {n for n in free if left * (names.index(n) % 3 + 1) / weights > 3 * own[n]}
        for n in free:
            target[n] = 3.0 * own[n] if n in over else left * (names.index(n) % 3 + 1) / weights
        if not over:
            break
        free -= over
    for r in made:
        assert r.m["size"] == sizes[r.doc_id] and r.m.source_size == own[source[r.doc_id]] and np.isclose(r.m.target, target[source[r.doc_id]])
        assert 0 <= r.m.copies <= 3
    assert sorted((r.doc_id, r.m.copies) for r in made) == sorted((r.doc_id, r["mix"].copies) for r in mixing.with_copies(docs.repartition(5)).collect())
    mixed = mixing.mix(clashing(docs))
    assert mixed.columns == [*clashing(docs).columns, "copy_"] and mixed.where("__n = 7 and __src = 7 and copy = 7 and mix = 7").count() == sum(r.m.copies for r in made)
    assert mixing.mix(docs).columns == [*docs.columns, "copy"] and mixing.mix(none).count() == 0


def test_mix_comes_near(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, "w " * int(r.lognormvariate(4, 1)), r.choice("aaab")) for i in range(4000)], "doc_id long, text string, source string")
    for row in mixing.with_copies(df).groupBy("source").agg(F.sum(F.col("mix.copies") * F.col("mix.size")).alias("t"), F.first("mix.target").alias("w")).collect():
        assert abs(row.t / row.w - 1) < 0.02


# 10


def test_other_models_are_refused(monkeypatch):
    """A model that folds or drops characters first, and a vocabulary that can't end a prefix."""
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor.encode
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "encode", lambda self, t: plain(self, t.replace("  ", " ")))
    with pytest.raises(ValueError, match="changes texts"):
        token_counts.PrefixCounter(token_counts.default_model())
    monkeypatch.undo()
    count = token_counts.PrefixCounter(token_counts.default_model())
    count.apart = lambda left, right: False
    with pytest.raises(ValueError, match="no token"):
        count.piece_counts("\u2581the")


def test_prefix_counts(spark, docs, none):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    count = token_counts.counter(token_counts.default_model())
    r = random.Random(9)
    parts = list("  ab eéx.,\n\t▁<s>日0🙂ñ th") + ["hello", "▁", "  ", "don't", "\x00", "</s>"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(400)]
    for t, p in zip(texts, count.prefixes(texts)):
        for i in range(len(t) + 1):
            assert p.tokens_of(i) == len(model.encode(t[:i])), t[:i]
    found = {x.doc_id: x for x in token_counts.token_budget(clashing(docs), 50).collect()}
    for x in docs.collect():
        t = x.text or ""
        assert (found[x.doc_id].n_bytes, found[x.doc_id].n_tokens) == (len(t.encode()), len(model.encode(t)))
        k = found[x.doc_id].fit_chars
        assert len(model.encode(t[:k])) <= 50 and (k == len(t) or found[x.doc_id].n_tokens > 50)
    arrays = token_counts.prefix_token_counts(docs.where("doc_id in (0, 3)")).orderBy("doc_id").collect()
    assert arrays[0].prefix_tokens == [] and len(arrays[1].prefix_tokens) == 3
    assert token_counts.token_budget(none).count() == 0


# pipeline


def brute_kept(text, rules):
    """The base rule and the learned rules, from plain counts."""
    t = text or ""
    n, chars, symbols, dup, repeat = brute_counts(t)
    lines, words = t.count("\n") + 1, re.findall(r"[^\x20\x09-\x0D]+", t)
    over = lambda a, b: a / b if b else 0.0
    count = lambda p: len(re.findall(p, t))
    x = [n, over(chars, n), over(symbols, n), over(count("[!?]"), n), over(count("[0-9]"), chars), over(count("[A-Z]"), chars), over(dup, lines), over(repeat, n), over(len(set(words)), n), over(n, lines)]
    fires = any(all(x[f] > cut if above else x[f] <= cut for f, above, cut in rule) for rule in rules)
    return n >= 20 and 100 * repeat <= 30 * n and not fires


def brute_mix(rows):
    """(id, number) of each copy: targets by repeated sharing, then one running sum a source."""
    md5 = lambda t, n: int(hashlib.md5(t.encode()).hexdigest()[:n], 16)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    own = {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    target, free = {}, list(names)
    while free:
        left, weights = sum(own.values()) - sum(target.values()), sum(names.index(n) % 3 + 1 for n in free)
        over = [n for n in free if left * (names.index(n) % 3 + 1) / weights >= 3 * own[n]]
        target |= {n: 3.0 * own[n] for n in over} if over else {n: left * (names.index(n) % 3 + 1) / weights for n in free}
        free = [n for n in free if n in over] and [n for n in free if n not in over]
    out = []
    for n in names:
        key = "1" if n is None else "0" + n
        bits = lambda s: s.bit_length() if s else 1
        order = sorted((bits(size[i]) * 8 + (size[i] >> max(bits(size[i]) - 4, 0) & 7), md5(f"mix-1:{i}", 8) % 64, i) for i, _, s in rows if s == n)
        rate, at = target[n] / own[n] if own[n] else 0.0, md5(f"mix-1:{key}", 5) / 1048576.0
        for k, (_, _, i) in enumerate(order, 1):
            out += [(i, c) for c in range(1, int(np.floor(k * rate + at) - np.floor((k - 1) * rate + at)) + 1)]
    return sorted(out)


def test_pipeline_odd_rows(spark, docs, none, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names through all stages; then an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    body = " ".join(f"{r.choice('abcdefgh')}{r.randint(0, 4000)}" for _ in range(60_000))
    whole = lambda a, b: " ".join(body.split()[a:b])
    rows = [
        (1, None, "en", "s0", 0), (2, "", "en", None, 0), (None, whole(0, 60), "en", "s1", 5), (None, whole(0, 60), "en", "s1", 5), (4, whole(100, 300), None, None, 7), (4, whole(100, 300), None, None, 7),
        (5, whole(100, 299), "en", "s0", 7), (6, body, "en", "s0", 9), (7, whole(400, 480) + " mail me: a@b.co", "en", "s1", 3),
    ]
    for name, start, want in (("odd", spark.createDataFrame(rows, SCHEMA), {None, 4, 6, 7}), ("none", none, set())):
        kept = clashing(start)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, kept, DATA).write.parquet(str(tmp_path / f"{name}{k}"))
            kept = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert kept.columns == clashing(start).columns + ["copy_"] * (k == 4) and kept.where("hits = 7 and rules = 7 and __n = 7 and `a.b` = 7 and copy = 7").count() == kept.count()
            found = [x.doc_id for x in kept.collect()]
            if k in (1, 2, 3):
                assert sorted(map(str, found)) == sorted(["None"] * 2 * bool(want) + [str(x) for x in want if x is not None])
        assert set(found) <= want and (not want or len(found) > 0)


def test_pipeline_stages(spark, docs, none, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, DATA)
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        before, kept = kept, spark.read.parquet(path)
        if name == "quality rules":
            rules = quality_rules.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect() if brute_kept(r.text, rules)}
        if name == "mixing sources":
            assert sorted((r.doc_id, r.copy) for r in kept.collect()) == brute_mix([(r.doc_id, r.text, r.source) for r in before.collect()])
        if name == "n-gram Jaccard join":
            texts = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
            want = {texts[i][0] for i, (_, root) in enumerate(brute_groups([t for _, t in texts])) if i == root}
            assert {r.doc_id for r in kept.collect()} == want
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect() if not brute_contamination(r.text, items)[1]}
        if name == "PII":
            assert not any(brute_spans(r.text) for r in kept.collect()) and kept.count() == before.count()
        if name != "mixing sources":
            assert kept.columns == before.columns and kept.count()
    assert corpus_pipeline.run(spark, DATA).count() == kept.count() > 0

"""Filter audit, MinHash join and importance resampling against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from formspark.llm import filter_audit, minhash, ngrams, resampling

LABELS = "doc_id bigint, quality int, toxic int"


def lowered(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


class TestFilterAudit:
    @pytest.mark.parametrize("n", [1, 3, 5])
    def test_ranks_and_intervals(self, n):
        orders = list(itertools.permutations(range(n)))
        for size in range(1, n + 1):
            for head in itertools.permutations(range(n), size):
                assert orders[filter_audit.rank(head, n)][:size] == head and all(o[:size] != head for o in orders[:filter_audit.rank(head, n)])
        left = {(m, r): next(s for s, k in enumerate(o) if m >> k & 1) for m in range(1, 1 << n) for r, o in enumerate(orders)}
        found = {(m, r): s for m, s, low, high in zip(*filter_audit.intervals(n), strict=True) for r in range(low, high)}
        assert found == left

    def brute(self, docs, labels):
        first = {}
        for i, _, t in docs:
            if i is not None:
                first[t or ""] = min(first.get(t or "", i), i)
        good = {i for i, q, _ in labels if q == 1}
        toxic = {i for i, _, x in labels if x == 1}
        rows = []
        for i, part, t in docs:
            t = t or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = [len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and t in first and i > first[t]]
            rows.append((part or "", dict(zip("ABCDE", fails, strict=True)), i in good, i in toxic))
        out = {}
        for part in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == part]
            total = Counter()
            for order in map("".join, itertools.permutations("ABCDE")):
                here = own
                for step, k in enumerate(order, 1):
                    gone, rest = [r for r in here if r[1][k]], [r for r in here if not r[1][k]]
                    total[k] += len(gone)
                    out[part, order, step] = [len(rest), len(gone), sum(r[1][k] for r in own) - len(gone), sum(r[1][k] and sum(r[1].values()) == 1 for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
                    here = rest
            for (p, order, step), row in out.items():
                if p == part:
                    row.append(total[order[step - 1]])
        return out

    def test_all_orders(self, spark):
        rng = random.Random(4)
        long = " ".join(f"w{k}" for k in range(120))
        texts = [None, "", "  \t", long, long, long.upper(), long + " #", "a " * 150, "É" * 20, "x%", "\x0b\x0c\x1c", "one word"]
        docs = [(rng.choice([None, *range(12)]), rng.choice([None, "", "en", "fr"]), rng.choice(texts)) for _ in range(60)]
        labels = [(rng.randrange(12), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(14)] + [(None, 1, 1)]
        frame = spark.createDataFrame([(*d, "x", "y") for d in docs], "doc_id bigint, lang string, text string, mask string, good string").repartition(3)
        got = filter_audit.audit_documents(frame, spark.createDataFrame(labels, LABELS)).collect()
        # a null id has no label
        want = self.brute(docs, [x for x in labels if x[0] is not None])
        assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == want and len(got) == len(want)

    def test_empty_and_wrong(self, spark):
        none = spark.createDataFrame([], "doc_id bigint, lang string, text string")
        assert filter_audit.audit_documents(none, spark.createDataFrame([], LABELS)).count() == 0
        with pytest.raises(ValueError, match="order"):
            filter_audit.audit(none, "lang", {"B": F.lit(True), "A": F.lit(True)}, F.lit(True), F.lit(True))


def grams(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return [zlib.crc32(b" ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


class TestResampling:
    @pytest.mark.parametrize(("block", "chunk"), [(1 << 18, 2 << 20), (1, 7), (3, 60)])
    def test_checksums_of_runs(self, monkeypatch, block, chunk):
        monkeypatch.setattr(ngrams, "BLOCK", block)
        monkeypatch.setattr(ngrams, "CHUNK", chunk)
        rng = random.Random(block)
        pieces = ["a", "B", "é", "9", " ", ".", "\n", "漢", *("z" * n for n in (47, 48, 49, 130)), "  ", "\x00"]
        texts = [None, "", " ", "one", *("".join(rng.choice(pieces) for _ in range(rng.choice([3, 30]))) for _ in range(20))]
        found = [[] for _ in texts]
        words = np.zeros(len(texts), int)
        for sums, of, n in ngrams.ngrams(pa.array(["before", *texts]).slice(1)):
            words += n
            for s, k in zip(sums.tolist(), of.tolist(), strict=True):
                found[k].append(s)
        assert [(sorted(f), n) for f, n in zip(found, words, strict=True)] == [(sorted(g), n) for g, n in map(grams, texts)]

    def brute(self, docs, target, least, percent):
        own, want = ([grams(t) for t in texts] for texts in ([t for _, t in docs], target))
        s, t = (Counter(x % 10_000 for g, _ in rows for x in g) for rows in (own, want))
        gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s.values()) + 10_000) / ((s[k] + 1) * (sum(t.values()) + 10_000)))) for k in range(10_000)]
        rows = []
        for (i, _), (g, n) in zip(docs, own, strict=True):
            h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            weight = sum(gain[x % 10_000] for x in g)
            rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
        return rows, able[:percent * len(able) // 100]

    @pytest.mark.parametrize(("percent", "least"), [(5, 20), (50, 1), (100, 0), (0, 0)])
    def test_draw(self, spark, percent, least):
        rng = random.Random(9)
        vocabulary = ["alpha", "Beta", "gamma9", "über", "x" * 60]
        docs = [(rng.choice([None, 1, 2, *range(3, 60)]), rng.choice([None, "", " . ", *(" ".join(rng.choices(vocabulary, k=n)) for n in (1, 25, 40))])) for _ in range(120)]
        docs += [(77, "alpha beta " * 15)] * 9  # rows that repeat tie with each other
        target = ["gamma9 alpha", None, "über über über"]
        frame = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id bigint, text string, score double").repartition(4)
        got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=least).collect()
        rows, drawn = self.brute(docs, target, least, percent)
        assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(rows)
        # rows of one id and score are drawn as often as they should be, whichever of them it is
        ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
        assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]

    def test_empty_tables_and_carried_columns(self, spark):
        none = spark.createDataFrame([], "doc_id bigint, text string")
        some = spark.createDataFrame([(1, "a b c " * 10, "x")], "doc_id bigint, text string, weight2 string")
        assert resampling.resample(none, none).count() == 0
        assert resampling.resample(none, some).count() == 0
        row = resampling.resample(some, none, percent=100, carry=["weight2"]).first()
        assert (row["rank"], row["weight2"], row["n_words"]) == (1, "x", 30)

    def test_nth_least(self, spark):
        values = [5, -3, 5, 5, 9, 10**15, -(10**15), 0]
        rows = spark.createDataFrame([(v,) for v in values], "v bigint")
        for n in range(1, len(values) + 1):
            value = sorted(values)[n - 1]
            assert resampling.nth_least(rows, F.col("v"), n) == (value, sum(v < value for v in values))


class TestMinHash:
    def brute(self, docs):
        def runs(text):
            words = lowered(text).split()
            return frozenset(b" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))) if words else frozenset()
        sets = [runs(t) for _, t in docs]
        parent = list(range(len(docs)))

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in itertools.combinations(range(len(docs)), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[top(a)] = top(b)
        out = []
        for k, (i, _) in enumerate(docs):
            ids = [docs[j][0] for j in range(len(docs)) if top(j) == top(k) and docs[j][0] is not None]
            least = min(ids) if ids else None
            out.append((i, len(sets[k]), least, i == least))
        return out

    def check(self, spark, docs):
        frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, node string").repartition(4)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame).collect()]
        assert Counter(got) == Counter(self.brute(docs))

    def test_odd_rows(self, spark):
        odd = [None, "", " \t\n", "one", "ONE", "one two", "a b c d", "A b  c\nd", "a b c d e", "É x y z", "é x y z", "é x y z w", "w " * 3000]
        self.check(spark, [*enumerate(odd), (None, "a b c d"), (None, "lone text of five words"), (3, "one"), (3, "again " * 9), (3, "one")])

    def test_near_copies_in_a_dense_group(self, spark, monkeypatch):
        """copies around the threshold, so that many pairs of one component are no links, among unrelated texts that share a passage"""
        monkeypatch.setattr(minhash, "BLOCK", 16)
        monkeypatch.setattr(minhash, "STRIP", 5)
        rng = random.Random(2)
        base = [f"b{k}" for k in range(120)]
        docs = []
        for k in range(70):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"n{rng.random()}"
            docs.append((1000 - k, " ".join(words)))
        passage = " ".join(f"p{k}" for k in range(60))
        docs += [(k, passage + " " + " ".join(f"u{rng.random()}" for _ in range(rng.randint(8, 60)))) for k in range(60)]
        self.check(spark, docs)

    def test_signatures_agree_as_sets_do(self):
        rng = np.random.default_rng(0)
        values = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
        rates = [np.mean(minhash.signature(np.sort(values[:1000 + k])) == minhash.signature(np.sort(values[k:1000 + k]))) for k in (0, 111, 250)]
        assert rates[0] == 1 and abs(rates[1] - 0.8) < 0.2 and rates[1] > rates[2]
        lists = [values[:3], values[:700], values[5:9]]
        assert np.array_equal(minhash.signatures(lists), np.stack([minhash.signature(x) for x in lists]))

    def test_empty_table(self, spark):
        assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0

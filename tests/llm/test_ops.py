"""Each operator against a plain-Python version, and on awkward tables."""

import hashlib
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataframe.llm import classify, decontaminate, hashing, html_text, line_dedup, mixing, ngram_join, pii, quality_rules, suffix_dedup, token_counts
from strataframe.llm import queries as llm
from strataframe.llm.graph import connected

DOC = "doc_id long, text string, lang string, source string, n_chars long"
AZ = {i: i + 32 for i in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, long, "en", "a", len(long)),
        (5, "same text of a few words here and there " * 30, "en", "b", 1),
        (5, "same text of a few words here and there " * 30, "en", "b", 1),
        (6, "same text of a few words here and there " * 30, None, None, 1),
        (None, "a row without an id has ten words in its text", "en", "a", 5),
        (7, "Ünïcode ﬁ 😀 " * 60 + "x", "xx", "c", 2),
        (8, "one", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("n_words", "n_tokens", "kept", "base_failed", "m", "id", "key", "score", "th", "label", "pass", "at", "comp")})


#: Names that the operators give to columns of their own.
OWN = "doc t own gone hit_ranges hit_items words lines grams places n_repeat_words own_lang own_source fence_ salt row __gone __w __f __hit_ranges".split()


def test_clashing_columns(spark, awkward):
    """Columns of these names change nothing, and come back as they were."""
    table = awkward.withColumns({c: F.lit(f"own {c}") for c in OWN})
    items = spark.createDataFrame([(1, "same text of a few words here and there same text of a few words here")], "item_id long, text string")
    for run in (quality_rules.quality_filter, line_dedup.line_dedup, ngram_join.keep_one, lambda d: decontaminate.decontaminate(d, items), lambda d: decontaminate.decontaminate(d, items.union(items.selectExpr("2", "concat(text, ' more')")), block_words=8)):
        got = run(table)
        assert got.columns == table.columns
        rows = got.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in OWN)
        assert Counter((str(r["doc_id"]), r["text"]) for r in rows) == Counter((str(r["doc_id"]), r["text"]) for r in run(awkward).collect())


@pytest.mark.parametrize("few", [0, 20_000])
def test_fences_joined_either_way(docs, monkeypatch, few):
    monkeypatch.setattr(quality_rules, "FEW_GROUPS", few)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()}
    monkeypatch.undo()
    assert got == {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_connected(spark):
    rng = np.random.RandomState(0)
    pairs = [(int(a), int(b)) for a, b in rng.randint(0, 300, (220, 2))]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["id"]: r["comp"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: find(x) for p in pairs if p[0] != p[1] for x in p}


# ---- 1


def test_html_layout():
    page = """<!DOCTYPE html><title>t</title><style>.ad, #x{display:none}</style><h1>Head  ing</h1><p>One<p>Two <b>bold</b>,x<br>line<div class="a ad">no</div><i id=x>no</i>
<ul><li>a<li>b<ol start=3><li>c<li>d</ol><li>e</ul><table><tr><th>Name<th>N<tr><td>Al<td>1<tr><td rowspan=2>wide cell<td>2<tr><td>3</table>
<pre>
 a
   b</pre>&lt;end&gt;<span hidden>h</span><script>var x="</p>";</script>tail <details>d<summary>s</summary></details>"""
    assert html_text.extract(page) == (
        "Head ing\n\nOne\n\nTwo bold,x\nline\n\n- a\n- b\n  3. c\n  4. d\n- e\n\n"
        "Name       N\nAl         1\nwide cell  2\n           3\n\n a\n   b\n\n<end>tail\ns"
    )
    assert html_text.extract("<div>" * 30_000 + "deep") == "deep"
    assert [html_text.extract(x) for x in (None, "", "   ", "<p>", "<", "a < b", "</p></div>")] == ["", "", "", "", "<", "a < b", ""]


@pytest.mark.parametrize(
    ("css", "seen"),
    [
        ("@media print{.main,nav{display:none}}", "M N"),
        ("@media (max-width:600px){nav{display:none}} @supports (display:grid){@media print{.main{display:none}}}", "M N"),
        ("@media screen{nav{display:none}}", "M"),
        ("@media print, screen{@layer a{nav{visibility:hidden}}}", "M"),
        ("nav{display:none} nav{display:block}", "M N"),
        ("nav{display:block} .main{display:none!important} .main{display:block}", "N"),
        ("@import 'x.css'; nav{display:none;} @keyframes k{from{display:none}}", "M"),
    ],
)
def test_html_sheets(css, seen):
    assert html_text.extract(f"<style>{css}</style><span class=main>M</span> <nav>N</nav>").split() == seen.split()


@pytest.mark.parametrize("unit", ["<div>", "<div><p>x", "<div ", "<", "<a '", "<!", "</p>", "<b>", "<table><tr><td>", "<ul><li>", "<!-- "])
def test_html_of_patterns_in_linear_time(unit):
    began = time.perf_counter()
    html_text.extract(unit * (200_000 // len(unit)))
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("unit", ["1", "a", "a.", "1.", "a@", "one ", "x dot ", "a at ", "1-", "a at b.co ", "10 dot 0 dot 0 dot 1 ", "[at] "])
def test_pii_of_patterns_in_linear_time(unit):
    began = time.perf_counter()
    pii.find_pii(unit * (1_000_000 // len(unit)) + ".")
    assert time.perf_counter() - began < 10


def test_pii_base_against_plain_patterns():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda x: re.sub("[^0-9]", "", x)
    double = lambda x: sum(int(c) for c in str(2 * int(x)))
    holds = {
        "email": lambda x: True,
        "ip": lambda x: all(int(p) <= 255 for p in x.split(".")),
        "card": lambda x: 14 <= len(digits(x)) <= 19 and sum(double(c) if i % 2 else int(c) for i, c in enumerate(reversed(digits(x)))) % 10 == 0,
        "phone": lambda x: 10 <= len(digits(x)) <= 15,
    }
    rng = np.random.RandomState(13)
    for _ in range(20_000):
        text = "".join(rng.choice(list("a1@..-% ,2+(4")) for _ in range(rng.randint(0, 40)))
        want = {k: [m.span() for m in re.finditer(p, text) if holds[k](m[0])] for k, p in plain.items()}
        assert pii.base_spans(text) == want, text


def test_html_formulas_labels_and_values():
    assert html_text.extract("a <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></semantics></math> b") == "a x=2 b"
    assert html_text.extract('<svg><title>t</title><defs><text>d</text></defs><path d="M0"/> z <text>Up <tspan>per</tspan></text><text>Low</text></svg>c') == "Up per Low c"
    shown = "".join(f'<input type={t} value="{t}1">' for t in "email tel url number date hidden password checkbox".split())
    assert html_text.extract(shown) == "email1 tel1 url1 number1 date1"


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, None, None), (None, "u", "x")], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((str(r["page_id"]), r["text"]) for r in got.collect()) == [("1", "a"), ("2", ""), ("None", "x")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


# ---- 2


def by_hand_hits(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))
    windows = {}
    for k, t in items:
        w = split(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(k)
    out = []
    for key, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((str(key), len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 700])
def test_contamination(spark, sf, docs, awkward, block):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "one"), (900, "one"), (None, "Same text of a FEW words"), (901, None), (902, "..."), (903, "there same text of a few words here and there same text of a few")], "item_id long, text string")
    items = bench.unionByName(extra)
    for table in (docs, awkward):
        want = by_hand_hits([(r["doc_id"], r["text"]) for r in table.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
        got = decontaminate.contamination(table, items, block_words=block).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
        kept = decontaminate.decontaminate(table, items, block_words=block)
        assert kept.columns == table.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == [k for k, n, h, _ in want if not (h and 20 * h >= n)]


def test_contamination_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == docs.count()
    assert decontaminate.contamination(empty, none).count() == 0


# ---- 3


def by_hand_counts(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) for k in range(3) if grams[tuple(w[i : i + 3])] > 1}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_counts_and_filter(docs, awkward, empty):
    for table in (docs, awkward):
        rows = quality_rules.quality_verdicts(table).collect()
        got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
        assert got == sorted((str(r["doc_id"]), *by_hand_counts(r["text"])) for r in table.collect())
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
        kept = quality_rules.quality_filter(table)
        assert kept.columns == table.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert quality_rules.quality_verdicts(empty).count() == 0 and quality_rules.quality_filter(empty).count() == 0


def test_sketch_quartiles_merge(spark):
    rng = np.random.RandomState(3)
    v = rng.gamma(2.0, 3.0, 4000)
    rows = spark.createDataFrame([("en", f"s{i % 3}", "x", float(x)) for i, x in enumerate(v)], "lang string, source string, measure string, v double")
    sketch = rows.withColumn("bucket", F.expr(quality_rules._bucket("v"))).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    got = quality_rules.quartiles(sketch, ["lang"]).first()
    assert got["n"] == 4000
    assert abs(got["q1"] / np.quantile(v, 0.25) - 1) < 0.03 and abs(got["q3"] / np.quantile(v, 0.75) - 1) < 0.03


# ---- 4


def test_mixture(spark, docs, awkward, empty):
    rows = mixing.mix(docs).collect()
    tokens = {r["doc_id"]: len(words(r["text"])) for r in docs.collect()}
    total = sum(tokens.values())
    of, spent = {}, Counter()
    for r in docs.collect():
        of.setdefault(r["source"], []).append(tokens[r["doc_id"]])
    for r in rows:
        assert r["n_tokens"] == tokens[r["doc_id"]]
        spent[r["source"]] += r["n_tokens"]
    plan = {r["source"]: r for r in mixing.weights(mixing.token_table(docs)).collect()}
    assert abs(sum(r["weight"] for r in plan.values()) - 1) < 1e-9 and sum(spent.values()) <= total
    w = np.array([r["weight"] for r in plan.values()])
    assert -(w * np.log(w)).sum() >= 0.9 * np.log(len(w)) - 1e-9
    times = Counter((r["doc_id"], r["pass"]) for r in rows)
    assert max(times.values()) == 1
    for s, r in plan.items():
        assert r["target"] <= 4 * r["tokens"] and spent[s] <= r["target"]
        assert r["target"] - spent[s] < 2 * max(of[s])
    assert mixing.mix(awkward).count() > 0 and mixing.mix(empty).count() == 0


def test_mixture_of_one_source_and_limits(spark):
    one = spark.createDataFrame([(i, "a b c", "en", None, 1) for i in range(5)], DOC)
    assert Counter(r["doc_id"] for r in mixing.mix(one).collect()) == Counter(range(5))
    assert Counter(r["doc_id"] for r in mixing.mix(one, budget=30).collect()) == Counter({i: 2 for i in range(5)})
    uneven = spark.createDataFrame([(i, "w " * 50, "en", "big", 1) for i in range(200)] + [(1000, "w " * 20, "en", "small", 1)], DOC)
    plan = {r["source"]: r for r in mixing.weights(mixing.token_table(uneven), entropy_share=1.0, max_repeats=3.0).collect()}
    assert plan["small"]["target"] <= 3 * 20


# ---- 5


def line_words(line):
    return re.findall(r"[^\W_]+", line.lower())


def edit(a, b):
    """Edits between two texts, or two lists of words. DuckDB counts bytes: each kind of item is one here."""
    code = {x: chr(1 + i) for i, x in enumerate(dict.fromkeys([*a, *b]))}
    if len(code) < 127:
        return duckdb.execute("select levenshtein(?, ?)", ["".join(code[c] for c in x) for x in (a, b)]).fetchone()[0]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    """Whether two lines (lists of words) are near-equal by the operator's definition; no SimHash, no blocks."""
    most = lambda x, y: int((1 - line_dedup.SIMILARITY) * max(len(x), len(y)) + 1e-9)
    if re.findall(r"\d+", " ".join(a)) != re.findall(r"\d+", " ".join(b)):
        return False
    apart = lambda x, y: max((Counter(x) - Counter(y)).total(), (Counter(y) - Counter(x)).total())  # noqa: E731  never more than the edits
    if apart(a, b) <= most(a, b) and edit(a, b) <= most(a, b):
        return True
    if max(len(a), len(b)) >= line_dedup.SHORT + 3:
        return False
    x, y = " ".join(a), " ".join(b)
    return apart(x, y) <= most(x, y) and edit(x, y) <= most(x, y)


def by_hand_gone(rows):
    """(id, line) of all but the first occurrence in each group of near-equal lines, by comparing all with all."""
    places = {}
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            if line.strip():
                places.setdefault(tuple(line_words(line)) or (line.strip(),), []).append((doc, i))
    names = sorted(places, key=lambda n: (sum(map(len, n)), n))
    root = {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 0.6 * sum(map(len, b)) > sum(map(len, a)):
                break
            if find(a) != find(b) and near(a, b):
                root[find(a)] = find(b)
    groups = {}
    for n in names:
        groups.setdefault(find(n), []).extend(places[n])
    return {at for g in groups.values() for at in g if at != min(g)}


def test_lines_against_all_pairs(spark):
    rng = np.random.RandomState(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.randint(3, 9))) for _ in range(400)]
    lines = [" ".join(rng.choice(vocab, n)) for n in (2, 3, 5, 7, 9, 12, 15, 16, 20, 30, 40, 60) for _ in range(4)]
    rows = []
    for d in range(60):
        text = []
        for k in rng.choice(len(lines), 5, replace=False):
            w = lines[k].split()
            if rng.rand() < 0.5:
                w[rng.randint(len(w))] = rng.choice(vocab)
            text.append(" ".join(w).capitalize() + rng.choice(["", ".", " 12"]))
        rows.append((d, "\n".join([*text, "short one"]), "en", "a", 1))
    table = spark.createDataFrame(rows, DOC)
    want = by_hand_gone([r[:2] for r in rows])
    got = {(r["doc"], r["line"]) for r in line_dedup.dropped_lines(table).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)  # blocks may miss a pair, but nothing else goes
    kept = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(table).collect()}
    assert kept == {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in got) for d, t, *_ in rows}


@pytest.mark.parametrize("change", ["letter", "dropped", "added", "twice"])
def test_recall_of_one_edit(spark, change):
    """Lines of the documents with an edit each, where that keeps a similarity of 0.9: found in 19 of 20 cases at least (two edits: 9 of 10)."""
    rng = np.random.RandomState(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0").collect()
    lines = sorted({" ".join(line_words(x)) for r in docs for x in (r["text"] or "").split("\n") if 5 <= len(line_words(x)) <= 120})
    made = []
    for line in rng.permutation(lines)[:600]:
        w = line.split()
        for _ in range(2 if change == "twice" else 1):
            at = rng.randint(len(w))
            if change == "dropped":
                del w[at]
            elif change == "added":
                w.insert(at, "zyx")
            else:
                k = rng.randint(len(w[at]))
                w[at] = w[at][:k] + "q" + w[at][k + 1 :]
        other = " ".join(w)
        if other != line and edit(line, other) <= 0.1 * max(len(line), len(other)):
            made.append((line, other))
    rows = [(2 * i + k, x, "en", "a", 1) for i, p in enumerate(made) for k, x in enumerate(p)]
    gone = {r["doc"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, DOC).repartition(4)).collect()}
    found = sum(2 * i + 1 in gone for i in range(len(made)))
    assert len(made) > 200 and found >= (0.9 if change == "twice" else 0.95) * len(made), (found, len(made))


def test_similarity_of_near_lines(spark):
    pairs = [("we saw that it was an old red barn near us", "we saw that it is an old rod bank near us"), ("a cat sat on the mat by the door", "a cat sat in the hat by the door")]  # 0.88, 0.94
    rows = [(2 * i + k, x, "en", "a", 1) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    rows += [(9, "some quite different line of words", "en", "a", 1), (10, "some quite other lines of words", "en", "a", 1)]  # 0.71
    rows += [(11, "total revenue of the year 2019 was 23,000 dollars", "en", "a", 1), (12, "total revenue of the year 2021 was 99,415 dollars", "en", "a", 1)]
    assert {r["doc"] for r in line_dedup.dropped_lines(spark.createDataFrame(rows, DOC)).collect()} == {1, 3}


def test_equal_lines_of_any_length(spark):
    text = "Next.\n* * *\n12 13\n\n日本語の文\n12,13\nnext\n12 14\nTwo words"
    rows = [(1, text, "en", "a", 1), (2, "Two words!\n\n* * *\n12 13\nother", "en", "a", 1)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {1: "Next.\n* * *\n12 13\n\n日本語の文\n12 14\nTwo words", 2: "\nother"}


def test_rows_that_share_an_id(spark):
    one, other = "a line that is here and there\nits own words stand here", "quite something else to read\na line that is here and there\nunrelated words in this row"
    rows = [(1, one, "en", "a", 1), (1, other, "en", "a", 1), (1, one, "en", "a", 1), (None, one + "\nlast", "en", "a", 1)]
    got = Counter(r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOC)).collect())
    left = [x.replace("a line that is here and there\n", "") for x in (one, other)]
    assert got["last"] == 1 and got in (Counter({one: 2, left[1]: 1, "last": 1}), Counter({other: 1, left[0]: 2, "last": 1}))


def test_simhash_by_hand(spark):
    lines = ["alpha beta gamma delta epsilon alpha", "the of and to in", "omega " * 20_001]
    got = {r["id"]: r["sig"] for r in line_dedup.simhashes(spark.createDataFrame([(i, "".join(chr(0x4E00 + len(w) + 50 * ord(w[0])) for w in x.split())) for i, x in enumerate(lines)], "id long, codes string")).collect()}
    hashes = {r["w"]: r["h"] & (2**64 - 1) for r in spark.createDataFrame([(w,) for x in lines for w in set(x.split())], "w string").selectExpr("w", "xxhash64(char_of) h".replace("char_of", "decode(unhex(hex(19968 + length(w) + 50 * ascii(w))), 'UTF-16BE')")).collect()}
    for i, x in enumerate(lines):
        bits = sum(1 << b for b in range(64) if 2 * sum(hashes[w] >> b & 1 for w in x.split()) > len(x.split()))
        assert got[i] & (2**64 - 1) == bits


def test_lines_of_awkward_tables(awkward, empty):
    got = line_dedup.line_dedup(awkward)
    assert got.columns == awkward.columns and got.count() == awkward.count()
    by = {str(r["doc_id"]): r["text"] for r in got.collect()}
    assert by["1"] is None and by["6"] == "" and by["5"] and by["None"] and by["2"] == ""
    assert line_dedup.line_dedup(empty).count() == 0


# ---- 6


def test_tree_edits_equal_recounts():
    encoding = token_counts._encoding(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    count = lambda x: len(encoding.encode_ordinary(x))
    rng = np.random.RandomState(7)
    fragments = ["a", " b", "  ", "\n", "\n\n x", " 12", "é", "'s", " 's", "¿?", "  \n a", "", "the quick " * 80, "　", "x_y 9z"]
    base = ["", " ", "\n\n  a b  c", "word " * 900, "日本語の文" * 200, "a\nb\nc\n" * 200, "x" * 3000]
    for leaf in (16, 512):
        for text in base:
            tree = token_counts.TokenTree.of(count, text, leaf)
            assert tree.n_tokens == count(text)
            for _ in range(15):
                start, length = int(rng.randint(-2, len(text) + 3)), int(rng.choice([0, 1, 3, 20, 400]))
                text = tree.edit(text, start, length, fragments[rng.randint(len(fragments))])
                assert tree.n_tokens == count(text) and tree.sums[0][1] == len(text)


def test_edits_of_tables(docs, awkward, empty):
    encoding = token_counts._encoding(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    for table in (docs.select("doc_id", "text"), awkward):
        counted = token_counts.count_tokens(table)
        for r in counted.collect():
            assert r["n_tokens"] == len(encoding.encode_ordinary(r["text"] or "")) == sum(r["leaf_tokens"])
        edited = token_counts.apply_edits(counted, token_counts.sample_edits(F.col("text"))).collect()
        assert len(edited) == table.count()
        for r in edited:
            assert r["n_tokens"] == len(encoding.encode_ordinary(r["text"]))
            assert r["n_encoded"] <= 3 * (3 * token_counts.LEAF + 40) or len(r["text"]) < 5000 or "w0x0" not in r["text"]
    same = token_counts.apply_edits(counted, F.lit(None)).collect()
    assert all(r["n_tokens"] == r["n_before"] and r["n_encoded"] == 0 for r in same)
    assert token_counts.apply_edits(token_counts.count_tokens(empty), F.lit(None)).count() == 0


# ---- 7


def by_hand_components(rows):
    sets = []
    for key, text in rows:
        w = words((text or "").translate(AZ))
        sets.append((key, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            k = len(a & b)
            if k and 100 * k >= 75 * (len(a) + len(b) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(sets):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted((str(key), len(s), str(least.get(find(i)) if s else key)) for i, (key, s) in enumerate(sets))


def test_components_against_all_pairs(spark, docs, awkward, empty):
    rng = np.random.RandomState(8)
    made = []
    for g in range(12):  # clouds of edited copies around the limit, of many sizes
        base = [f"g{g}w{k}" for k in rng.randint(0, 10_000, int(rng.choice([3, 5, 7, 9, 12, 20, 60, 150])))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 15 + 1)):
                w[rng.randint(len(w))] = f"x{rng.randint(100)}"
            made.append((len(made), " ".join(w[: len(w) - rng.randint(0, 2)] if rng.rand() < 0.3 else w), "en", "a", 1))
    clouds = spark.createDataFrame(made, DOC)
    for table in (clouds, docs, awkward):
        want = by_hand_components([(r["doc_id"], r["text"]) for r in table.collect()])
        got = ngram_join.ngram_components(table).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and Counter(str(r["doc_id"]) for r in kept.collect()) == Counter(["1", "2", "3", "4", "5", "None", "7", "8"])


def test_frequent_tokens_take_the_other_paths(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "RARE", 1)  # no token is rare: subsets of all tokens, and what follows
    test = [(i, " ".join(["common"] * 3 + [f"c{k}" for k in range(30)] + [f"d{i % 7}"] * (i % 3)), "en", "a", 1) for i in range(30)]
    table = spark.createDataFrame(test, DOC)
    got = ngram_join.ngram_components(table).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == by_hand_components([(r[0], r[1]) for r in test])


# ---- 8


def by_hand_repeats(rows, length):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(x[q : q + length] for _, x in data for q in range(len(x) - length + 1))
    out = []
    for k, x in data:
        gone = bytearray(len(x))
        for q in range(len(x) - length + 1):
            if seen[x[q : q + length]] > 1:
                gone[q : q + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((str(k), len(x), sum(gone), sum(1 for j in range(len(x)) if gone[j] and (j == 0 or not gone[j - 1])), kept))
    return sorted(out)


@pytest.mark.parametrize(("hot", "alike"), [(suffix_dedup.HOT, suffix_dedup.ALIKE), (1, suffix_dedup.ALIKE), (1, 1)])
def test_repeats_against_all_windows(spark, docs, awkward, empty, monkeypatch, hot, alike):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "ALIKE", alike)
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, ("é" if i % 2 else "z") * i + passage[i % 3 : 500 + 11 * (i % 7)] + f" tail {i} " * (i % 4), "en", "a", 1) for i in range(25)]
    rows += [(100, "ab" * 700, "en", "a", 1), (101, "x" + "ab" * 300, "en", "a", 1), (102, "y" * 399, "en", "a", 1), (103, "y" * 399, "en", "a", 1)]
    made = spark.createDataFrame(rows, DOC)
    for table in (made, docs) if hot == 1 else (made, docs, awkward):
        want = by_hand_repeats([(r["doc_id"], r["text"]) for r in table.collect()], 400)
        got = suffix_dedup.remove_repeats(table).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_passages_of_words(spark, docs, awkward):
    rng = np.random.RandomState(12)
    fresh = lambda n: [f"{x}" for x in rng.randint(0, 10**9, n)]
    shared = ["an", "it"] * 30
    rows = [(0, " ".join(fresh(20) + shared[:51] + fresh(9)), "en", "a", 1), (1, "\n".join(fresh(3) + shared[:51]), "en", "a", 1), (2, " ".join(fresh(30) + [x.upper() for x in shared[:51]]), "en", "a", 1)]
    p = fresh(51)
    rows += [(3, " ".join(p + fresh(5)), "en", "a", 1), (4, "  ".join(fresh(7) + p), "en", "a", 1), (5, " ".join(fresh(7) + p[:50]), "en", "a", 1)]
    for table in (spark.createDataFrame(rows, DOC), docs, awkward):
        texts = [(str(r["doc_id"]), words(r["text"])) for r in table.collect()]
        seen = Counter(tuple(w[i : i + 51]) for _, w in texts for i in range(len(w) - 50))
        want = sorted((d, len({k for i in range(len(w) - 50) if seen[tuple(w[i : i + 51])] > 1 for k in range(i, i + 51)})) for d, w in texts)
        got = suffix_dedup.remove_repeats(table, passage=51).collect()
        assert sorted((str(r["doc_id"]), r["n_passage_words"]) for r in got) == want


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.RandomState(9)
    contexts = [bytes(rng.randint(97, 99, 30 + 40).astype(np.uint8)) for _ in range(200)]
    group = np.array(sorted(rng.randint(0, 9, 200).tolist()))
    s = suffix_dedup.Suffixes(group, contexts, np.full(200, 30), 40, 10)
    order = s.sort().tolist()
    assert [(int(group[i]), contexts[i][30:]) for i in order] == sorted((int(g), c[30:]) for g, c in zip(group, contexts))
    i, j = np.arange(199), np.arange(1, 200)
    want = [next((k for k in range(40) if a[30 + k] != b[30 + k]), 40) for a, b in zip(contexts, contexts[1:])]
    assert s.common(i, j).tolist() == want
    # hashes that tell nothing apart: the bytes decide
    s.behind[:] = 0
    marked = s.repeated(np.zeros(200, int), np.full(200, 30))
    for o in (0, 7, 30):
        seen = Counter((int(g), c[30 - o : 70 - o]) for g, c in zip(group, contexts))
        assert marked[:, o].tolist() == [seen[int(g), c[30 - o : 70 - o]] > 1 for g, c in zip(group, contexts)]


def test_long_texts_are_cut_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    rng = np.random.RandomState(10)
    text = "".join(rng.choice(list("abcdefgh "), 6000))
    rows = [(1, text, "en", "a", 1), (2, "q" * 50 + text[900:1600] + "r" * 50, "en", "a", 1), (3, text[5500:] + text[:300], "en", "a", 1)]
    want = by_hand_repeats([(r[0], r[1]) for r in rows], 400)
    anchors = suffix_dedup._segments([text.encode()], 400)
    starts = sorted(at + q for _, at, piece in anchors for q in range(len(piece) - 399))
    assert starts == list(range(len(text) - 399))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == want


# ---- 9


def test_classifier_on_held_out_rows(spark, docs, empty):
    big = "/root/testdata/sf0.01"
    rows = llm.QUERIES["op9_quality_classifier"](spark, big).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{big}/labels.parquet").toPandas().set_index("doc_id")["quality"]
    assert rows.held_out.equals(rows.index.to_series().map(lambda x: zlib.crc32(str(x).encode()) % 5 == 0).rename("held_out"))
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.3)).all()
    both = rows[rows.held_out].join(labels, how="inner")
    assert (both.predicted == both.quality).mean() > 0.9


def test_classifier_of_awkward_tables(spark, awkward, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    model = classify.fit(awkward, labels)
    assert len(model.labels) == 2
    got = classify.scored(awkward, model)
    assert got.count() == awkward.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = classify.fit(empty, labels)
    assert classify.scored(awkward, none).where("score <> 0.5").count() == 0 and classify.scored(empty, model).count() == 0


# ---- 10


def test_pii_base_by_hand():
    text = "a.b+c@d-e.co.uk x 999.1.1.1 10.0.0.255, 4111 1111-1111 1111, 4111111111111112, +1 (212) 555-0199 ext +12 +44 20 7946 0958"
    base = pii.base_spans(text)
    show = lambda k: [text[a:b] for a, b in base[k]]
    assert show("email") == ["a.b+c@d-e.co.uk"] and show("ip") == ["10.0.0.255"] and show("card") == ["4111 1111-1111 1111"]
    assert show("phone") == ["+1 (212) 555-0199", "+44 20 7946 0958"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.base_spans("1.2.3.4.5")["ip"] == [(0, 7)] and pii.base_spans("0000000300.1.1.1")["ip"] == []


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("write to john dot smith at example dot com now", "email", "john dot smith at example dot com"),
        ("x a.b [at] c-d [dot] org!", "email", "a.b [at] c-d [dot] org"),
        ("mail user(at)example.com, foo", "email", "user(at)example.com"),
        ("mail user at example.com, foo", "email", "user at example.com"),
        ("usеr@exаmple.com", "email", "usеr@exаmple.com"),
        ("ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｕｓｅｒ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus one two one two five five five oh one nine nine.", "phone", "plus one two one two five five five oh one nine nine"),
        ("call +1 (212) five five five 0199 x", "phone", "+1 (212) five five five 0199"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("ip 10 dot 0 dot 0 dot 1 .", "ip", "10 dot 0 dot 0 dot 1"),
        ("ip 192[.]168[.]0[.]1", "ip", "192[.]168[.]0[.]1"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, spans = pii.find_pii(text)
    assert not base[kind]
    assert [text[a:b] for a, b in spans[kind]] == [found]


def test_pii_leaves_plain_text():
    for text in ("meet me at noon. Then we go", "one two three and four", "at the dot of ten", "he is at home. dot it", "Привет, как дела", "five or six of seven"):
        assert not any(pii.find_pii(text)[1].values()), text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("eight dot eight dot eight dot eight", "ip:0:35"),
        ("ping one zero dot zero dot zero dot one.", "ip:5:39"),
        ("to 10 dot zero dot zero dot 1 now", "ip:3:29"),
        ("one dot two dot three", ""),
        ("one dot two dot three dot four dot five", ""),
        ("nine nine nine dot one dot one dot one", ""),
        ("user at example.nl", "email:0:18"),
        ("write to ann.lee at mail.example.it today", "email:9:35"),
        ("bob at firm.co, eve at firm.ch", "email:0:14,email:16:30"),
        ("we stayed at home.Then it rained", ""),
        ("an error at index.js", ""),
    ],
)
def test_short_spelled_ips_and_other_domains(text, want):
    assert pii.listed(pii.find_pii(text)[1]) == want


def test_pii_table(docs, awkward, empty):
    rows = {r["doc_id"]: r for r in pii.personal_data(docs).collect()}
    for r in docs.collect():
        base, spans = pii.find_pii(r["text"])
        assert rows[r["doc_id"]]["base"] == pii.listed(base) and rows[r["doc_id"]]["spans"] == pii.listed(spans)
        assert set(filter(None, pii.listed(base).split(","))) <= set(pii.listed(spans).split(","))
    assert pii.personal_data(awkward).count() == awkward.count() and pii.personal_data(empty).count() == 0
    digest = llm.QUERIES["op10_personal_data"]
    assert digest


# ---- hashing


def test_patterns_do_not_cancel_out(spark):
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    assert len(a) == 1024 and len(set(hashing.words([f"{a} {b} {a[:300]} {b[:300]}".encode()], hashing.BLANK)[0].tolist())) == 4
    texts = [f"{x} {' '.join(f'w{i}' for i in range(3))}" for x in (a, b)]
    got = ngram_join.ngram_components(spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], DOC)).collect()
    assert sorted(r["component_id"] for r in got) == [0, 1]
    items = spark.createDataFrame([(1, texts[0])], "item_id long, text string")
    found = decontaminate.contamination(spark.createDataFrame([(i, x, "en", "a", 1) for i, x in enumerate(texts)], DOC), items).collect()
    assert sorted((r["doc_id"], r["n_hit"]) for r in found) == [(0, 4), (1, 0)]
    kept = suffix_dedup.remove_repeats(spark.createDataFrame([(0, "x" + a + "y", "en", "a", 1), (1, "z" + b + "w", "en", "a", 1)], DOC)).collect()
    want = by_hand_repeats([(0, "x" + a + "y"), (1, "z" + b + "w")], 400)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in kept) == want


def test_shingles_across_pieces(monkeypatch):
    monkeypatch.setattr(hashing, "SLICE", 64)
    rows = [b"", b"one two", ("é " * 100 + "x" * 200 + " end of it all now").encode(), b"  a\tb\nc\x0bd\x0ce\rf  "]
    cut = hashing.shingles(rows)
    monkeypatch.undo()
    whole = hashing.shingles(rows)
    assert all((a == b).all() for a, b in zip(cut, whole)) and [len(x) for x in whole] == [0, 1, len({tuple(words(rows[2].decode())[i : i + 5]) for i in range(102)}), 2]


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(name, llm.QUERIES[name], llm.SQL[name])


def test_digests(spark, sf, docs):
    row = llm.QUERIES["op8_suffix_dedup"](spark, sf).where("n_removed = 0").first()
    text = docs.where(F.col("doc_id") == row["doc_id"]).first()["text"]
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_pairs_of_a_large_bucket_are_all_compared(spark, monkeypatch):
    from strataframe.llm import graph

    monkeypatch.setattr(graph, "DEALT", 100)
    buckets = spark.range(600).select(F.lit(1).cast("long").alias("key"), "id", F.lit(0).alias("sig"))
    found = graph.linked_groups(buckets, lambda pairs: pairs.where("b = a + 300"), few_first=True)
    assert sorted(map(tuple, found.select("id", "comp").collect())) == [(i, i % 300) for i in range(600)]


def test_lines_alike_in_a_large_bucket_of_unlike_ones_are_found(spark):
    """300 lines that share three words, in pairs that differ in one letter: few leaders would miss most."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9))
    lines = [" ".join(["alpha", "beta", "gamma", *(word() for _ in range(3))]) for _ in range(150)]
    rows = [(2 * i, x) for i, x in enumerate(lines)] + [(2 * i + 1, x[:-1] + "y") for i, x in enumerate(lines)]
    texts = spark.createDataFrame([(i, f"r{i}", x, x, i * 0 + 6) for i, x in rows], "id long, g0 string, norm string, u string, n int")
    texts = texts.select("id", F.xxhash64("g0").alias("g"), "n", "norm", F.expr(line_dedup._CODES).alias("codes"), F.xxhash64(F.lit("")).alias("digits"))
    met = spark.createDataFrame([(7, i) for i, _ in rows], "key long, id long")
    groups = line_dedup._groups(texts, met, 0.85)
    got = {r["h"]: r["comp"] for r in groups.collect()}
    near = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(150)], "a long, b long")
    sigs = line_dedup.simhashes(texts)
    bits = {(r["a"], r["b"]) for r in near.join(sigs.withColumnsRenamed({"id": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"id": "b", "sig": "y"}), "b").where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= line_dedup.FEW_DISTANCE).select("a", "b").collect()}
    assert len(bits) > 30
    assert all(got.get(a, -1) == got.get(b, -2) for a, b in bits)


def test_lines_meet_on_every_block_that_they_share(spark):
    """Lines 1 and 2 share only the commonest of line 1's blocks; lines 3 and 4 one block of eight."""
    rows = [(1, [12, 16, 20, 24, 32], False), (2, [32], False)] + [(10 + b, [b], False) for b in (12, 16, 20, 24)] + [(50, [32], False)]
    rows += [(3, list(range(100, 132, 4)), True), (4, list(range(128, 160, 4)), True)]
    met = line_dedup._met(spark.createDataFrame(rows, "h long, blocks array<bigint>, full boolean"))
    got = {}
    for x in met.collect():
        got.setdefault(x["key"], set()).add(x["id"])
    assert got[32] == {1, 2, 50} and got[128] == {3, 4} and got[12] == {1, 22}


def test_only_near_equal_lines_leave_the_full_comparison(spark, monkeypatch):
    """400 lines that share three of six words: many of their pairs have close SimHashes, few are near-equal."""
    from strataframe.llm import graph

    rng = np.random.default_rng(6)
    lines = [" ".join(["alpha", "beta", "gamma", *("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 9)) for _ in range(3))]) for _ in range(400)]
    texts = spark.createDataFrame([(i, x, x, 6) for i, x in enumerate([*lines, lines[0][:-1] + "y"])], "id long, g0 string, norm string, n int")
    texts = texts.select("id", F.xxhash64("g0").alias("g"), "n", "norm", F.expr(line_dedup._CODES).alias("codes"), F.xxhash64(F.lit("")).alias("digits"))
    sizes, whole = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: [out := whole(df), sizes.append(out.count())][0])
    groups = line_dedup._groups(texts, texts.select(F.lit(7).cast("long").alias("key"), "id"), 0.85)
    assert groups is None or {(r["h"], r["comp"]) for r in groups.collect()} == {(0, 0), (400, 0)}
    assert max(sizes) < 3 * 401


def test_ids_that_share_many_buckets_are_compared_once(spark):
    """30 ids that share 20 buckets have 435 pairs, and 8,700 places where they meet."""
    from strataframe.llm import graph

    tried = spark.sparkContext.accumulator(0)

    def alike(x, y):
        tried.add(1)
        return {x, y} == {3, 17}

    buckets = spark.range(20).select(F.col("id").alias("key")).crossJoin(spark.range(30)).select("key", "id", F.lit(0).alias("sig"))
    sketches = spark.range(30).select("id", F.col("id").alias("sketch"))
    groups = graph.linked_groups(buckets, lambda pairs: pairs.where("false"), sketches=sketches, near=F.udf(alike, "boolean"), exact=True, in_full=64)
    assert sorted(map(tuple, groups.select("id", "comp").collect())) == [(3, 3), (17, 3)]
    assert tried.value <= 435


def test_rows_carry_their_buckets_only_where_the_join_makes_the_links(spark, monkeypatch):
    """Where pairs are verified after the join they are made distinct there; lists of buckets on all rows would multiply the shuffle."""
    from strataframe.llm import graph

    columns, whole = set(), graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: [columns.update(df.columns), whole(df)][1])
    buckets = spark.range(20).select(F.col("id").alias("key")).crossJoin(spark.range(30)).select("key", "id", F.lit(0).alias("sig"))
    sketches = spark.range(30).select("id", F.col("id").alias("sketch"))
    groups = graph.linked_groups(buckets, lambda pairs: pairs.where("a = 3 and b = 17"), sketches=sketches, near=lambda x, y: y - x == 14, in_full=64)
    assert sorted(map(tuple, groups.select("id", "comp").collect())) == [(3, 3), (17, 3)]
    assert "buckets" not in columns


def test_copies_of_a_line_do_not_meet(spark):
    rows = [(1, [12, 16])] * 50 + [(2, [16, 20])] * 3 + [(3, [24])]
    met = line_dedup._met(spark.createDataFrame(rows, "h long, blocks array<bigint>").repartition(4))
    assert sorted(map(tuple, met.select("key", "id").collect())) == [(16, 1), (16, 2)]


def test_lines_of_other_digits_share_no_block(spark):
    text = "order of seven red apples 12\norder of seven red apples, 12!\norder of seven red apples 13\n(12) order of seven red apples"
    rows = {r["at"]["line"]: set(r["blocks"]) for r in line_dedup._line_rows(spark.createDataFrame([(1, text, "en", "a", 1)], DOC)).collect()}
    assert rows[0] == rows[1] and rows[0] & rows[3]
    assert not rows[0] & rows[2]


def test_tokens_travel_in_slices_of_the_universe(docs):
    batches = [docs.select("doc_id", "text").toArrow().to_batches()[0]]
    n = ngram_join.SLICES
    sent = lambda *part: list(ngram_join._tokens_of(hashing.shingles, 4, *part)(iter(batches)))
    passes, whole = [sent(k, n) for k in range(n)], sent()
    bytes_of = lambda out: sum(len(x.as_py()) for b in out for x in b["tokens"] if x.is_valid)
    assert max(map(bytes_of, passes)) < 0.5 * bytes_of(whole)
    triples = lambda out: Counter(zip(*(x.tolist() for x in ngram_join._unpacked([b.filter(b["tokens"].is_valid()) for b in out])), strict=True))
    assert sum(map(triples, passes), Counter()) == triples(whole)
    ids = [[x for b in out for x, there in zip(b["doc_id"].to_pylist(), b["n"].is_valid().to_pylist(), strict=True) if there] for out in passes]
    assert ids[0] == batches[0]["doc_id"].to_pylist() and not any(ids[1:])

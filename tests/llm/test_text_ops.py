import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphframe.llm import html_text, line_dedup, neighbours, quality_model, queries, rule_cascade, source_mix, token_rollup, toxicity
from glyphframe.llm.runtime import Scratch

from .conftest import words_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).fetchdf()
    columns = sorted(got.columns)
    rows = lambda d: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d[columns].astype(object).itertuples(index=False, name=None))
    assert sorted(want.columns) == columns and rows(got) == rows(want)


def repeat_words(text):
    words = words_of(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_rules_by_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    for n in (0, 4, 5, 6, 40, 300):
        text = " ".join(rng.choice(list("abc"), n))
        assert rule_cascade.Document(text.encode()).n_repeat_words == repeat_words(text)
    rows = rule_cascade.judge(odd_docs, report=True).collect()
    for row, text in zip(rows, [r.text for r in odd_docs.collect()], strict=True):
        assert row.n_words == len(words_of(text)) and row.word_chars == sum(len(w.decode()) for w in words_of(text))
        assert row.base_failed == (row.n_words < 10 or 100 * row.n_repeat_words > 20 * row.n_words) and (not row.kept or not row.base_failed)
    kept = rule_cascade.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in rows)
    assert rule_cascade.judge(no_docs, report=True).count() == 0


def test_rules_give_one_verdict_in_any_order():
    texts = [b"", b"a b c", b"x " * 50, " ".join(f"word{i}" for i in range(60)).encode(), b"### " * 40, " ".join(f"WORD{i}A" for i in range(60)).encode()] * 5
    eager, late = rule_cascade.Cascade(sample=1), rule_cascade.Cascade(sample=1000)
    assert [eager.keeps(t) for t in texts] == [late.keeps(t) for t in texts]


def test_mix_reaches_every_target(spark, odd_docs, no_docs):
    rows = [(i, "w " * (1 + i % 7), f"s{min(i // 100, 3)}") for i in range(500)] + [(900 + i, "x", None) for i in range(3)]
    mixed = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = (r.target, r.source_size)
        assert r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.part
    for s, (t, size) in target.items():
        assert abs(taken[s] - t) < 1 and t <= 3 * size
    assert sum(t for t, _ in target.values()) == pytest.approx(sum(r.size for r in mixed))
    again = source_mix.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in mixed)
    assert source_mix.mix(odd_docs).count() == odd_docs.count() and source_mix.mix(no_docs).count() == 0
    copies = source_mix.mixed_documents(odd_docs)
    assert copies.columns == odd_docs.columns and copies.where("text is null or trim(text) = ''").count() == 0


CLASHES = ("h", "pos", "form", "gone", "gone_id", "component", "component_id", "kept", "copies", "copy", "mixed_id", "removed_id", "size", "key", "c0", "c1", "n", "size_x", "__id", "__gone", "__copy", "doc id")


def test_columns_of_any_name_pass_by(spark):
    from glyphframe.llm import near_dedup

    text = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text, "a", *["v"] * len(CLASHES)), (2, text, "a", *["w"] * len(CLASHES)), (3, "another text of its own", "b", *["x"] * len(CLASHES))], ["doc_id", "text", "source", *CLASHES])
    for kept in (line_dedup.dedup_lines(docs), near_dedup.deduplicated(docs), source_mix.mixed_documents(docs), rule_cascade.filter_documents(docs)):
        assert kept.columns == docs.columns
        assert all(set(r[3:]) == {"vwx"[r.doc_id - 1]} for r in kept.collect())
    renamed = docs.withColumnRenamed("doc_id", "id").withColumnRenamed("h", "doc_id")
    assert sorted(r.component_id for r in near_dedup.near_duplicates(renamed, id="id").collect()) == [1, 1, 3]


def test_lines_keep_one_of_a_group(spark, odd_docs, no_docs):
    long = "the quick brown fox jumps over the lazy dog and then it runs away from all of the other animals in this very large and very green field"
    docs = [(1, f"{long}\nown line one\n\n!!!"), (2, f"{long.upper()}.\nsecond\n\n!!!"), (3, long + " 12\nsecond"), (4, long + " 47"), (5, "second"), (6, None), (None, "second")]
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows[1] == docs[0][1] and rows[2] == "second\n\n!!!" and rows[5] == "" and rows[6] is None and rows[None] == "second"
    assert rows[4] == "", "digits are the same"
    got = line_dedup.dedup_lines(odd_docs)
    assert got.columns == odd_docs.columns and got.count() == odd_docs.count() and line_dedup.dedup_lines(no_docs).count() == 0


def test_lines_with_a_changed_word_are_found(spark):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    docs, pairs = [], {}
    for n in (6, 10, 20, 30, 50):
        for k in range(40):
            words = list(rng.choice(vocabulary, n))
            changed = [*words]
            changed[rng.integers(n)] = "yyyyyy"
            docs += [(1000 * n + k, " ".join(words)), (1000 * n + 500 + k, " ".join(changed))]
            pairs[1000 * n + 500 + k] = n
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    gone = [r.doc_id for r in rows if r.text == ""]
    assert set(gone) <= set(pairs), "lines that are like no other stay"
    for n in (6, 10, 20, 30, 50):
        assert sum(pairs[i] == n for i in gone) >= 38, f"{n} words"


def grouped(spark, docs):
    """The component of each class that is in a group."""
    scratch = Scratch(spark)
    prints = scratch.save(line_dedup.fingerprints(line_dedup.line_table(docs, "doc_id", "text")))
    return {r.h: r.component for r in line_dedup.line_groups(scratch, docs, prints, "doc_id", "text").read().collect()}


def test_line_links_against_edit_similarity_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    groups = grouped(spark, docs)
    forms = docs.select(F.explode(F.split(F.lower("text"), "\n")).alias("line")).select(line_dedup.normal(F.col("line")).alias("form")).where("form <> ''").distinct()
    forms = Scratch(spark).save(forms.select("form", F.xxhash64("form").alias("h"), F.length("form").alias("size"))).read().repartition(16)
    a, b = forms.alias("a"), F.broadcast(forms).alias("b")
    near = a.join(b, F.expr("a.h < b.h and abs(a.size - b.size) <= 0.2 * greatest(a.size, b.size) and levenshtein(a.form, b.form, int(0.2 * greatest(a.size, b.size))) >= 0"))
    near = near.select("a.h", F.col("b.h").alias("other"), F.levenshtein("a.form", "b.form").alias("d"), F.greatest("a.size", "b.size").alias("size")).collect()
    found = sum(r.h in groups and groups[r.h] == groups.get(r.other) for r in near)
    assert len(near) >= 10 and found >= 0.9 * len(near), f"{found} of {len(near)}"
    # No group holds lines that no chain of near lines joins.
    root = {r.h: r.h for r in forms.collect()}

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    for r in near:
        root[max(find(r.h), find(r.other))] = min(find(r.h), find(r.other))
    for h, component in groups.items():
        assert find(h) == find(component)


def test_lines_of_any_length_have_a_simhash(spark):
    rng = np.random.default_rng(5)
    kinds = [list("abcdefg"), ["alpha", "beta", "gamma", "delta"], ["日本語テキスト" * 9], ["x" * 3000]]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 2, 40, 30_000) for words in kinds if n * len(words[0]) < 300_000]
    prints = line_dedup.fingerprints(line_dedup.line_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")).collect()
    assert sorted(r.doc_id for r in prints if r.main) == list(range(len(texts)))
    for r in prints:
        assert all(b is None or bin(b).count("1") <= line_dedup.BITS for b in [r[f"b{k}"] for k in range(line_dedup.BLOCKS)])


def test_a_block_has_the_majority_of_its_words(spark):
    words = ["water", "stone", "cloud", "river", "field", "house", "light", "night", "green", "brown", "small", "large"]
    rows = line_dedup.fingerprints(line_dedup.line_table(spark.createDataFrame([(1, " ".join(words * 2))], "doc_id long, text string"), "doc_id", "text")).where("code = 0").collect()
    hashed = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).select("h", F.hash("h").alias("p")).collect()
    assert len(rows) == 1
    for k in range(8):
        own = [r.h for r in hashed if (r.p & 3 if k < 4 else (r.p % (1 << 32) >> 8 & 3) + 4) == k]
        bits = sum(1 << (4 * lane + half) for lane in range(15) for half in (0, 1) if 2 * sum(h >> (4 * lane + half) & 1 for h in own) > len(own))
        assert rows[0][f"b{k}"] == (bits if own else None)


def test_short_lines_are_compared(spark):
    docs = [(1, "subscribe to our newsletter"), (2, "Subscribe to our newsletters!"), (3, "newsletter"), (4, "newsletters"), (5, "ab"), (6, "ac"), (7, "other"), (8, "other")]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), n_lines="n", n_removed="gone").collect()
    assert sorted(r.doc_id for r in rows if r.text == "") == [2, 4, 8] and all(r.n == 1 for r in rows)


def test_lines_that_agree_on_any_block_are_compared(spark):
    a = "ble thntes erreha that erstlyer rent tiingtion of from it hable the whouor ofertionatre lytionble reshti the thnt nt"
    b = "ble thntes erreha that erstlyer that tiingtion of ednd it hable thlyre whouor ofertionatre lytionble reshti the thnt nt"
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: a, 2: ""}, "their only equal blocks are the sixth and the seventh"


def test_short_lines_are_compared_whatever_their_other_blocks(spark):
    """SimHashes of the first pair differ in 58 bits, of the second in 53."""
    docs = [
        (1, "ouelle les euxaich la en oich équevi de oument èqueêle aiéèeuxelleaux èaieux ououêè pament"),
        (2, "ouelle les euxaich la en la équevi de oument leauxaux aiéèeuxelleaux èaieux ououêè pamentê"),
        (3, "in erre to it rendon whrehe at"),
        (4, "in erre to it therble whrehe at"),
    ]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in rows if r.text == "") == [2, 4]


def test_lines_of_short_words_are_compared(spark):
    a = "the cat sat on the mat and the dog ran to the big red car by the old oak at the end of a day"
    b = "the cat sat on the mat and the hen ran to the big red car by the old oak at the end of a day"
    assert len(a) > 75
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: a, 2: ""}, "no word has four letters"


def test_edits_in_most_words_are_counted_whole(spark):
    long = ["window", "garden", "silver", "mother", "orange", "planet", "stream", "bridge", "forest", "candle", "marble", "pocket"]
    a, b = (" ".join([*long, *["ab" if changed is None or n >= changed else "ac" for n in range(40)]]) for changed in (None, 38))
    assert len(a) == 203
    rows = line_dedup.dedup_lines(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in rows} == {1: a, 2: ""}, "38 of 40 edits"


def test_a_large_group_is_not_compared_in_rows(spark, monkeypatch):
    """Stragglers have the SimHash of 210 like lines and are like none of them."""
    rng = np.random.default_rng(11)
    long = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(20)]
    pair = lambda: "".join(rng.choice(list("nopqrstuvwxyz"), 2))
    short = [pair() for _ in range(30)]
    copies = [[*long, *short[:n], pair(), *short[n + 1 :]] for n in range(30) for _ in range(7)]
    stragglers = [[*long, *[pair()[::-1].upper() for _ in range(30)]] for _ in range(60)]
    docs = spark.createDataFrame([(n, " ".join(words)) for n, words in enumerate([*copies, *stragglers])], "doc_id long, text string")
    counts, save = [], Scratch.save

    def counted(self, df):
        table = save(self, df)
        counts.append(table.read().count())
        return table

    monkeypatch.setattr(Scratch, "save", counted)
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.text == ""}
    assert set(range(1, 210)) <= gone and not gone - set(range(210)), "the stragglers stay"
    assert max(counts) < 6_000, "210 lines and 60 stragglers are 12,600 pairs"


def test_short_pairs_that_are_no_links_are_no_rows(spark, monkeypatch):
    """Lines of the same words in other orders agree on all blocks, counts and many runs, and are unlike."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(12)]
    orders = [[words[i] for i in rng.permutation(12)] for _ in range(200)]
    changed = {200 + k: ["nnnnnn" if w == words[3] else w for w in orders[k]] for k in (60, 150)}
    docs = spark.createDataFrame([(n, " ".join(line)) for n, line in [*enumerate(orders), *changed.items()]], "doc_id long, text string")
    counts, save = [], Scratch.save

    def counted(self, df):
        table = save(self, df)
        counts.append(table.read().count())
        return table

    monkeypatch.setattr(Scratch, "save", counted)
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.text == ""} == set(changed)
    assert max(counts) < 6_000, "202 lines are 20,301 pairs"


def made_by_joins(plan):
    """The rows that each join of a plan that has run made."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for p in inner for n in made_by_joins(p)]


def test_no_join_makes_rows_of_pairs_that_are_no_links(spark, monkeypatch):
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("abcdefghijklm"), 6)) for _ in range(12)]
    orders = [[words[i] for i in rng.permutation(12)] for _ in range(300)]
    changed = {300 + k: ["nnnnnn" if w == words[3] else w for w in orders[k]] for k in (60, 150)}
    docs = spark.createDataFrame([(n, " ".join(line)) for n, line in [*enumerate(orders), *changed.items()]], "doc_id long, text string").repartition(1)
    counts, save = [], Scratch.save

    def counted(self, df):
        df.collect()
        counts.extend(made_by_joins(df._jdf.queryExecution().executedPlan()))
        return save(self, df)

    monkeypatch.setattr(Scratch, "save", counted)
    monkeypatch.setattr(line_dedup, "CROWD", 120)  # their keys are dealt in three parts
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).collect() if r.text == ""} == set(changed)
    assert len(counts) > 10 and max(counts) < 20_000, "302 lines are 45,451 pairs"


def test_marks_leave_room_for_every_edit(spark):
    rng = np.random.default_rng(14)
    forms = {"", "a", "the the the the the the the the", "日本語 テキスト 日本語"}
    for _ in range(60):
        form = list(rng.choice(list("ab é"), rng.integers(1, 90)))
        for _ in range(4):
            forms.add("".join(form))
            at = rng.integers(len(form))
            form[at : at + rng.integers(2)] = list(rng.choice(list("abx"), rng.integers(3)))
            form = form or ["a"]
    made = line_dedup.marks(spark.createDataFrame(list(enumerate(sorted(forms))), "h long, form string"))
    rows = made.join(spark.createDataFrame(list(enumerate(sorted(forms))), "h long, form string"), "h")
    x, y = rows.alias("x"), rows.alias("y")
    names = [f"m{k}" for k in range(line_dedup.MARKS)]
    apart = F.greatest("x.marked", "y.marked") - line_dedup._shared_bits(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), names)
    pairs = x.join(y, F.col("x.h") < F.col("y.h")).where("length(x.form) > 1 and length(y.form) > 1")
    assert pairs.where(apart > 2 * F.levenshtein("x.form", "y.form")).count() == 0 and pairs.where(apart > 0).count() > 1000


def test_long_lines_that_differ_in_a_word_are_linked(spark):
    text = "a b c d " * 8_250
    docs = spark.createDataFrame([(1, text + "x"), (2, text + "y")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}[2] == ""


def test_all_clusters_of_a_page_without_article():
    long, short = "<p>" + "a long line of words " * 19 + "</p>", "<p>a short line of it</p>"
    page = f"<body><div id=content><div class=part1>{long * 5}</div><div class=part2>{short * 3}</div><div class=part3>{long * 4}</div></div></body>"
    assert [len(line) for line in html_text.main_text(page).split("\n")] == [398] * 5 + [18] * 3 + [398] * 4


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='no-comments'", "div class='elementor-widget-container'", "div id=social-page", "form id=aspnet"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_wrappers_of_the_page_are_not_set_aside(wrapper, tag):
    text = "<p>" + "a long line of words " * 19 + "</p>"
    page = f"<body><{wrapper}><{tag} id=text>{text * 4}</{tag}><div class=comments><p>first comment</p></div></{wrapper.split()[0]}></body>"
    assert html_text.main_text(page) == "\n".join(["a long line of words " * 18 + "a long line of words"] * 4)
    side = f"<body><{tag} id=text>{text * 4}</{tag}><div class='ad-slot'><p>buy this now</p></div><form><p>subscribe to it</p></form></body>"
    assert html_text.main_text(side) == html_text.main_text(page)


def test_rollup_commits_once(spark, no_docs):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).root}/r")
    rows = spark.createDataFrame([("a", "en", "t", 5), ("a", "en", "t", None), (None, "en", "t", 2)], "source string, lang string, tokenizer string, tokens long")
    assert rollup.totals().count() == 0
    assert rollup.commit("one", token_rollup.inserted(rows)) and not rollup.commit("one", token_rollup.inserted(rows))
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit("one", token_rollup.inserted(rows.limit(1)))
    assert rollup.compact() and not rollup.commit("one", token_rollup.inserted(rows))
    with pytest.raises(ValueError, match="other changes"):
        rollup.commit("one", token_rollup.deleted(rows))
    rollup.commit("two", token_rollup.revised(rows.where("tokens = 5"), rows.where("tokens = 5").selectExpr("source", "'de' lang", "tokenizer", "9L tokens")))
    rollup.commit("three", token_rollup.deleted(rows.where("source is null")))
    rollup.commit("none", token_rollup.inserted(rows.where("false")))
    assert sorted(map(tuple, rollup.totals().collect())) == [("a", "de", "t", 1, 9), ("a", "en", "t", 1, 0)]
    for _ in range(3):
        assert rollup.compact() and rollup.totals().count() == 2


def test_a_batch_committed_during_a_compaction_counts_once(spark):
    rollup = token_rollup.Rollup(spark, f"{Scratch(spark).root}/r")
    rows = spark.createDataFrame([("a", "en", "t", 5)], "source string, lang string, tokenizer string, tokens long")
    rollup.commit("one", token_rollup.inserted(rows))
    other = token_rollup.Rollup(spark, rollup.root)
    summed, other._sum = other._sum, lambda *state: (rollup.commit("two", token_rollup.inserted(rows)), summed(*state))[1]
    assert other.compact()
    assert list(map(tuple, rollup.totals().collect())) == [("a", "en", "t", 2, 10)]
    # Of two compactions at once, the second finds the first's manifest.
    late = token_rollup.Rollup(spark, rollup.root)
    summed_late, late._sum = late._sum, lambda *state: (rollup.compact(), summed_late(*state))[1]
    assert not late.compact()
    # One that died before it moved its commits to done is settled by readers and by the next.
    rollup.commit("three", token_rollup.inserted(rows))
    died = token_rollup.Rollup(spark, rollup.root)
    died._settle = lambda manifest: None
    assert died.compact()
    assert list(map(tuple, rollup.totals().collect())) == [("a", "en", "t", 3, 15)]
    assert rollup.compact() and list(map(tuple, rollup.totals().collect())) == [("a", "en", "t", 3, 15)]


def test_rollup_query_against_counts_one_by_one(spark, odd_docs, no_docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want, seen = {}, set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        if r.text is None or r.text not in seen:
            seen.add(r.text)
            key = (r.source, r.lang, "byte_bpe_50k/2")
            docs, tokens = want.get(key, (0, 0))
            want[key] = docs + 1, tokens + len(encoding.encode_ordinary(r.text or ""))
    got = {tuple(r[:3]): tuple(r[3:]) for r in queries.op5_token_rollup(spark, SF).select("source", "lang", "tokenizer", "docs", "tokens").collect()}
    assert got == want
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    copies = {(r.doc_id, r.bytes): r.copy for r in token_rollup.with_copies(token_rollup.counted_documents(odd_docs, *args)).collect()}
    some = " ".join(f"alpha{i} beta{i}" for i in range(40))
    assert copies[(1, len(some))] is False and copies[(2, len(some))] is True and copies[(None, len(some))] is False and copies[(3, 0)] is False
    assert token_rollup.with_copies(token_rollup.counted_documents(no_docs, *args)).count() == 0


def test_bpe_counts(spark, odd_docs):
    import public_tokenizers

    counts = token_rollup.rank_file_tokens(odd_docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert [r.tokens for r in counts if r.doc_id == 4] == [0] and all(r.tokens > 0 for r in counts if r.doc_id in (1, 11))


PAGES = [
    (None, ""), ("", ""), ("<p>a&amp;b &#x41;&nbsp;c</p>", "a&b A c"), ("<html><body><script>x<p>", ""), ("plain", "plain"),
    ("<nav><a href=x>Menu</a></nav><article><h1>T</h1><p><b>x  y<br><p>z\n w</article><footer>f</footer>", "T\nx y\nz w"),
    ("<div id=header>Site</div><div class='main-menu'><a>A</a></div><div id=text><h1>Title</h1><p>A long paragraph of words that go on and on here.</p><p>Short.</p></div><div class=comments><p>I say so at length, and more than once.</p></div>", "Title\nA long paragraph of words that go on and on here.\nShort."),
]


def test_deep_pages_take_no_more_than_their_length():
    import time

    n = 30_000
    for page in ("<b>x" * n + "</i>" * n, "<div>x" * n, "<i><article>" + "<b>x<p>" * n + "</i>" * n, "<article>x" * n, "<div class=ad>x" * n, "<span><h1>a" * n, "<p>word " * n):
        began = time.time()
        html_text.main_text(page)
        assert time.time() - began < 5, page[:20]


def test_ratios_decide_where_elements_do_not():
    long = "a long line of words that says much more than any menu could, again and again " * 5
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(30))
    page = f"<body><table><tr><td><ul>{links}</ul></td><td><div>{long}</div><div>{long}</div><div>short</div></td></tr></table></body>"
    assert html_text.main_text(page) == "\n".join([long.strip(), long.strip(), "short"])


def test_several_articles_and_what_main_holds_beside_them():
    text = "<p>" + "a long line of words " * 19 + "</p>"
    line = ("a long line of words " * 19).strip()
    assert html_text.main_text(f"<body><nav>menu</nav><article>{text * 2}</article><article>{text * 3}</article></body>") == "\n".join([line] * 5)
    assert html_text.main_text(f"<body><p>before</p><main><h1>Title</h1><article>{text * 3}</article><p>after it</p></main></body>") == "\n".join(["Title", *[line] * 3, "after it"])
    assert html_text.main_text(f"<body><article>{text * 3}</article><article class=comment>{text}</article></body>") == "\n".join([line] * 3)


def test_a_paragraph_that_is_one_link_stays_and_lists_of_links_go():
    text = "<p>" + "a long line of words " * 19 + "</p>"
    page = f"<body><div id=text>{text * 2}<p><a href=x>the whole of this paragraph is a link</a></p>{text * 2}<ul>" + "<li><a href=y>other page</a></li>" * 4 + "</ul></div></body>"
    got = html_text.main_text(page).split("\n")
    assert len(got) == 5 and got[2] == "the whole of this paragraph is a link"


def test_pages(spark):
    rows = html_text.extract(spark.createDataFrame([(i, None, h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert [r.text for r in rows] == [t for _, t in PAGES] and [r.n_chars for r in rows] == [len(t) for _, t in PAGES]


def recall(spark, rows, asked, got):
    """The share of the five truly nearest that were found; scores, ranks and ties are exact."""
    usable = [(i, np.array(v, float)) for i, v in rows]
    unit = np.array([v / np.linalg.norm(v) for _, v in usable])
    found = 0
    for q in asked:
        own = next(v for i, v in usable if i == q)
        cosines = unit @ (own / np.linalg.norm(own))
        best = sorted((-c, i) for c, (i, _) in zip(cosines, usable, strict=True) if i != q)[:5]
        found += len({i for _, i in best} & {i for _, i, _ in got[q]})
        assert [r for r, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        scores = [s for _, _, s in sorted(got[q])]
        assert scores == sorted(scores, reverse=True)
        for _, i, s in got[q]:
            assert any(abs(s - c) < 1e-12 for c, (j, _) in zip(cosines, usable, strict=True) if j == i)
    return found / (5 * len(asked))


def hits(found):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return got


def test_neighbours_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (None, rows[0][1]), (9005, [None] * 64), (9006, [1.0])]
    twice = [(9004, rows[5][1]), (9004, rows[5][1])]
    vectors = spark.createDataFrame([(i, v, "x", 0) for i, v in [*rows, *odd, *twice]], "vec_id long, embedding array<float>, own string, shard int")
    got = hits(neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0 or vec_id > 9000")).collect())
    assert set(got) == {*range(0, 500, 50), 9004}
    assert recall(spark, [*rows, *twice], list(got), got) >= 0.9
    few = vectors.where("vec_id < 3")
    assert neighbours.nearest(few, few.where("vec_id = 0")).count() == 2 and neighbours.nearest(few.where("false"), few.where("false")).count() == 0


def test_neighbours_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 256)
    rng = np.random.default_rng(6)
    loose = rng.standard_normal((3000, 32))
    near = loose[rng.integers(0, 60, 1500)] + 0.2 * rng.standard_normal((1500, 32))
    same = np.repeat(loose[:1], 900, axis=0)  # more than a shard holds, all in one cell
    rows = list(enumerate(np.concatenate([loose, near, same]).tolist()))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    found = neighbours.nearest(vectors, vectors.where("vec_id % 50 = 7")).collect()
    got = hits(found)
    asked = [i for i in range(len(rows)) if i % 50 == 7]
    assert set(got) == set(asked)
    apart = [q for q in asked if q < 4500]
    assert recall(spark, rows, apart, got) >= 0.9
    assert all([i for _, i, _ in sorted(got[q])] == sorted({0, *range(4500, 5400)} - {q})[:5] for q in asked if q >= 4500), "ties go to smaller ids"
    verified = {r.query_id: r.verified for r in found}
    assert np.mean([verified[q] for q in apart]) < 0.6 * len(rows), "the search stops before it has seen most vectors"


def held_out(rows, labels, folds, out):
    hit = [(r.predicted == labels[r.doc_id]) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % folds == out]
    return sum(hit) / len(hit)


def test_the_training_sample_is_bounded(spark):
    from glyphframe.llm import training

    docs = spark.createDataFrame([(i % 5, "x" * (1 + i), "clash", 0) for i in range(20)] + [(7, None, "clash", 0)], "doc_id long, text string, mark string, `order` int")
    sample = spark.createDataFrame([(i, i % 2, i) for i in range(9)], "doc_id long, mark int, `order` long")
    seen = lambda texts, marks: np.array([len(texts), sum(map(len, texts)), marks.sum()], float)
    rows, size, marked = training.trained(docs, "doc_id", "text", sample, seen)
    assert rows == 6 and marked == 3, "an id is learnt once, whatever the number of its rows"
    some = training.trained(docs, "doc_id", "text", sample, seen, most_bytes=int(size) - 1)
    assert some[0] < rows and some[1] <= size - 1
    assert list(training.trained(docs, "doc_id", "text", sample, seen)) == [rows, size, marked]


def test_classifiers_on_held_out_labels(spark, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r for r in labels.collect()}
    rows = quality_model.quality_scores(docs, labels).collect()
    assert held_out(rows, {i: r.quality for i, r in known.items()}, 4, 2) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert held_out(rows, {i: r.toxic for i, r in known.items()}, 3, 1) > 0.95
    marks = spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for scored in (quality_model.quality_scores(odd_docs, marks), toxicity.toxicity_scores(odd_docs, marks)):
        assert scored.count() == odd_docs.count()
    assert quality_model.quality_scores(no_docs, marks).count() == 0 and toxicity.toxicity_scores(no_docs, marks).count() == 0
    assert {r.score for r in quality_model.quality_scores(odd_docs, marks.where("false")).collect()} == {0.5}

"""The training-data operators against brute force, on small tables made by hand."""

from __future__ import annotations

import ctypes
import hashlib
import io
import itertools
import random
import re
import wave
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import harness
from meshwork.llm import line_dedup as lines
from meshwork.llm import near_dedup as near
from meshwork.llm import bpe_codec, packing, span_dedup, token_counts, url_filter
from meshwork.llm.bpe import vocabulary_path
from meshwork.llm.bpe_codec import bpe_round_trip, decode_documents, encode_documents
from meshwork.llm.components import connected_components
from meshwork.llm.exact_dedup import exact_dedup
from meshwork.llm.language_id import Learning, fit, gram_counts, held_out, language_id, sample
from meshwork.llm.media import from_wav, media_columns, padded, to_wav
from meshwork.llm.queries import oracle_sql, queries
from meshwork.llm.runtime import materialize, prepare
from meshwork.sources import memory, shared

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, lang="en"):
    """documents with clashing extra columns."""
    rows = [(i, t, lang, "s", len(t or ""), "x", 1, "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCUMENTS + ", digest string, run int, node string")


WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    draws = random.Random(seed)
    return " ".join(draws.choices(WORDS, k=n))


#: Null, empty, blank and letterless texts, ties, repeated rows, null ids, one long text.
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "same text here\nand a second line\nthird"), (5, "same text here\nand a second line\nthird"), (5, "same text here\nand a second line\nthird"),
    (None, "same text here\nand a second line\nthird"), (None, None), (6, "123 !!"), (7, "é"), (8, "One. Two. Three four. " * 3000), (9, "<|endoftext|> x"), (10, "\n".join(["again"] * 9)), (-11, "same text here\nand a second line\nthird"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, ODD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, []).cache()


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


# Exact dedup


@pytest.mark.parametrize(("runs", "fan_in"), [(1, 2), (7, 2), (64, 8)])
def test_exact_dedup(spark, odd, runs, fan_in):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(odd, runs, fan_in).collect())
    wanted = Counter()
    for i, text in ODD:
        same = [j for j, t in ODD if (t or "") == (text or "")]
        keep = max((j for j in same if j is not None), default=None)
        wanted[(i, keep, len(same), i is not None and i == keep, hashlib.sha256((text or "").encode()).hexdigest())] += 1
    assert got == wanted


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows_by_sql(spark, sf_dir, name):
    assert harness.rows_of_spark(queries()[name](spark, sf_dir)) == harness.rows_of_sql(harness.tables(sf_dir), oracle_sql()[name])


def test_exact_dedup_merges_sorted_runs(spark, odd):
    """The sort that a merge stands on is in the plan, no window or sort has a key of its own run alone, and nothing runs Python."""
    found = exact_dedup(odd, 64, 8)
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert len(re.findall(r"\+- Window ", plan)) == 2 and len(re.findall(r"\+- Sort \[run", plan)) == 2
    assert not re.search("Python|Arrow|Pandas", plan)


# Near dedup


def brute_components(texts, near_):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        k = min(near_.words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    label = {i: i for i, _ in texts if i is not None}
    links = [(a[0], b[0]) for x, a in enumerate(texts) for y, b in enumerate(texts[:x]) if a[0] is not None and b[0] is not None and sets[x] and 100 * len(sets[x] & sets[y]) >= near_.percent * len(sets[x] | sets[y])]
    for _ in texts:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return Counter((i, len(s), label.get(i), i is not None and label[i] == i) for (i, _), s in zip(texts, sets))


def chained(n):
    """Near copies of one text: many miss each other, as edits grow along a chain."""
    base, out = prose(5, 160).split(), []
    draws = random.Random(9)
    for i in range(n):
        for _ in range(draws.choice((1, 1, 2, 3, 9))):
            base[draws.randrange(len(base))] = draws.choice(WORDS)
        if i % 9 == 0:
            base = prose(5, 160).split()
        out.append((100 + i, " ".join(base)))
    return out


@pytest.mark.parametrize("stars", [0, 1, 2])
@pytest.mark.parametrize("rule", [near.QUERY, near.Near()])
def test_near_groups(spark, stars, rule):
    from dataclasses import replace

    texts = chained(60) + ODD + [(50 + i, " ".join(WORDS[: 6 + i % 4])) for i in range(12)]
    rule = replace(rule, stars=stars)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(table(spark, texts), rule).collect())
    assert got == brute_components(texts, rule)


@pytest.mark.parametrize("most", [4, 0])
def test_exact_rest_in_small_blocks(spark, monkeypatch, most):
    """Many blocks and turns; with ``most`` 0 more stars come first, and a centre's edges are dealt out."""
    monkeypatch.setattr(near, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(near, "COPIES", most)
    monkeypatch.setattr(near, "CENTRE_EDGES", 5)
    monkeypatch.setattr(near, "CENTRE_SHARE", 10**9)
    texts = chained(60)
    from dataclasses import replace

    rule = replace(near.QUERY, stars=0)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_groups(table(spark, texts), rule).collect())
    assert got == brute_components(texts, rule)


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (7, 7), (None, 1), (3, 5)], "a long, b long")
    assert sorted(map(tuple, connected_components(e, 4).collect())) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]


# Lines


def brute_lines(texts, least):
    """Every run of lines with so many words, of whatever length, held against those before it."""
    seen, gone = set(), {}
    order = sorted({(i, t) for i, t in texts if i is not None and t is not None}, key=lambda x: x[0])
    for i, t in order:
        body = t.split("\n")
        words = [len(x.encode().split()) for x in body]
        gone[(i, t)] = set()
        for k in range(len(body)):
            for m in range(k + 1, len(body) + 1):
                if sum(words[k:m]) >= least:
                    key = tuple(body[k:m])
                    gone[(i, t)] |= set(range(k, m)) if key in seen else set()
                    seen.add(key)
    return Counter((i, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))) for i, t in texts)


LINES = ["a", "b c", "", "d e f", "g h i j k l m n o", "p q r s"]


@pytest.mark.parametrize("least", [1, 4, 8, 20])
def test_line_dedup(spark, least):
    draws = random.Random(3)
    texts = ODD + [(20 + i, "\n".join(draws.choices(LINES, k=draws.randrange(1, 16)))) for i in range(40)]
    got = Counter((r.doc_id, r.text) for r in lines.line_dedup(table(spark, texts), least).collect())
    assert got == brute_lines(texts, least)


def test_intervals_hold_all_suffixes_of_a_run(spark):
    everything = {i: "abcabcab"[i:] for i in range(4)}
    docs = table(spark, [(i, "\n".join(t)) for i, t in everything.items()])
    lengths = set()
    for n, by_rank in lines.doubled(docs, 3):
        found = lines.occurrences(n, by_rank)
        for r in lines.intervals(found).collect():
            run = everything[r["first"].doc_id][r["first"].line :][: r.lines]
            assert len(run) == r.lines and r["size"] == sum(t.startswith(run, k) for t in everything.values() for k in range(len(t)))
            lengths.add(r.lines)
    assert lengths == {3}


def test_ranks_follow_the_order_of_suffixes(spark):
    """Of two suffixes the one that is smaller in its first 2k line ids has the smaller rank, and equal ones share it."""
    docs = table(spark, [(i, "\n".join(random.Random(i).choices("ab", k=12))) for i in range(6)])
    levels = lines.doubled(docs, 12)
    assert [n for n, _ in levels] == [1, 2, 4, 8] or [n for n, _ in levels] == [1, 2, 4]
    for (n, small), (_, large) in itertools.pairwise(levels):
        rank = {(r.doc_id, r.line): r["rank"] for r in small.collect()}
        pairs = sorted(((rank[(r.doc_id, r.line)], rank[(r.doc_id, r.line + n)]), r["rank"]) for r in large.collect())
        assert all((x == y) == (a == b) and a <= b for (x, a), (y, b) in itertools.pairwise(pairs))


# Spans


def test_sentences_join_to_the_text():
    for _, t in ODD:
        assert "".join(span_dedup.sentences(t or "")) == (t or "")
    assert span_dedup.sentences("the end of The passage. Next one") == ["the end of ", "The passage. ", "Next one"]


def brute_spans(texts, rule):
    """Spans as tuples of words, document by document in the order of ids."""
    kept, seen = {}, {}

    def spans(parts):
        words = [p.lower().encode().split() for p in parts]
        full = [k for k, w in enumerate(words) if w]
        for x, k in enumerate(full):
            for step in (1, -1):
                have, y = list(words[k]), x
                while len(have) < rule.words and 0 <= y + step < len(full):
                    y += step
                    have = have + words[full[y]] if step > 0 else words[full[y]] + have
                if len(have) < rule.words:
                    continue
                size = max(rule.words, len(words[k]))
                cut = have[:size] if step > 0 else have[-size:]
                whole = [z for z in range(min(x, y), max(x, y) + 1) if z != y or y == x or len(cut) == len(have)]
                start = sum(len(words[z]) for z in full[: min(x, y)]) + (len(have) - len(cut) if step < 0 else 0)
                yield tuple(cut), start, full[whole[0]], full[whole[-1]]

    for i in sorted({i for i, t in texts if i is not None and t is not None}):
        own = set()
        for t in sorted({t for j, t in texts if j == i and t is not None}):
            parts, gone = span_dedup.sentences(t), set()
            found = list(spans(parts))
            for key, start, a, b in found:
                own.add(key)
                if key in seen or any(key == other and before < start for other, before, _, _ in found):
                    gone |= set(range(a, b + 1))
            kept[(i, t)] = "".join(p for k, p in enumerate(parts) if k not in gone)
        seen.update(dict.fromkeys(own))
    return Counter((i, kept.get((i, t), t)) for i, t in texts)


@pytest.mark.parametrize("words", [5, 12, 40])
def test_span_dedup_against_brute_force(spark, words):
    draws = random.Random(7)
    pool = [f"{' '.join(draws.choices(WORDS[:6], k=draws.randrange(1, 14))).capitalize()}{draws.choice('.!?')}" for _ in range(25)] + ["...", "\n"]
    texts = ODD + [(200 + i, draws.choice(" \n").join(draws.choices(pool, k=draws.randrange(1, 16)))) for i in range(40)]
    texts += [(300, prose(50, 45)), (301, f"{prose(51, 20)} {prose(50, 45)}"), (302, prose(50, 45).upper())]
    rule = span_dedup.Spans(words)
    got = Counter((r.doc_id, r.text) for r in span_dedup.span_dedup(table(spark, texts), rule).collect())
    assert got == brute_spans(texts, rule)


def test_span_dedup(spark, odd):
    passage = " ".join(f"{prose(s, 20).capitalize()}." for s in range(3))
    texts = [(1, f"{prose(11, 30)} {passage} {prose(12, 30)}"), (2, f"{prose(13, 40)} {passage} {prose(14, 9)}"), (3, prose(15, 60)), (None, passage), (4, None), (5, f"{passage} {passage}")]
    got = {(r.doc_id, r.n_removed > 0): r.text for r in span_dedup.span_dedup(table(spark, texts), carry=["lang", "digest"]).collect()}
    assert got[(1, False)] == texts[0][1] and got[(3, False)] == texts[2][1] and got[(None, False)] == passage and got[(4, False)] is None
    assert got[(2, True)] == f"{prose(13, 40)} {prose(14, 9)}"
    assert got[(5, True)].strip() == ""
    clean = {r.doc_id: r.text for r in span_dedup.span_dedup(odd).collect()}
    assert clean[1] is None and clean[2] == "" and clean[6] == "123 !!" and len(clean[8]) < 100


def test_passages_of_over_50_words_lose_their_sentences(spark):
    """A passage that begins and ends inside sentences loses the whole ones; a repeat of 30 words stays."""
    draws = random.Random(8)
    running = prose(21, 70).split()
    for k in (12, 30, 48):
        running[k] = running[k].capitalize()
    texts = [(1, f"{prose(22, 15)} {' '.join(running)} {prose(23, 20)}"), (2, f"{prose(24, 25)} {' '.join(running)} {prose(25, 5)}")]
    texts += [(3, f"{prose(26, 50)} {' '.join(running[12:42])} {prose(27, 50)}")]
    got = {r.doc_id: r for r in span_dedup.span_dedup(table(spark, texts)).collect()}
    assert got[1].text == texts[0][1] and got[3].text == texts[2][1] and draws
    assert got[2].text == f"{prose(24, 25)} {' '.join(running[:12])} {' '.join(running[48:])} {prose(25, 5)}"


# Language


def test_every_language_is_sampled(spark):
    rows = spark.createDataFrame([(i, f"l{i:04}", "some text") for i in range(1010)], "doc_id long, lang string, text string")
    assert {lang for lang, _, _ in sample(rows, 1500)} == {f"l{i:04}" for i in range(1010)}


def test_language_id(spark):
    kinds = {"xx": "aeiou", "yy": "bcdfg"}
    texts = [(i, " ".join("".join(random.Random(i * 50 + k).choices(kinds["xx" if i % 2 else "yy"], k=6)) for k in range(30)), "xx" if i % 2 else "yy") for i in range(160)]
    rows = [(i, t, lang, "s", 0) for i, t, lang in texts] + [(900, None, "xx", "s", 0), (901, "", None, "s", 0), (902, "12 !", "zz", "s", 0), (None, "aeiou", None, "s", 0), (903, "aeiou" * 200_000, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCUMENTS)
    got = language_id(docs, Learning(max_rows=100)).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by_id[i].lang_pred == lang for i, _, lang in texts)
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in texts)
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (900, 901, 902))
    assert by_id[903].lang_pred == "xx" and by_id[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got)


def test_language_learns_nothing_from_what_is_held_out(spark):
    docs = spark.createDataFrame([(i, "abc def", "a" if zlib.crc32(str(i).encode()) % 4 != 2 else "b", "s", 7) for i in range(40)], DOCUMENTS)
    model = fit(docs)
    assert model.languages == ("a",)
    assert fit(docs.where(~held_out(F.col("doc_id")))).languages == ("a",)
    assert fit(docs.withColumn("lang", F.lit(None).cast("string"))).languages == ()


def test_letterless_texts_teach_nothing(spark):
    docs = spark.createDataFrame([(0, "abc def", "a", "s", 7), (1, "12 \u00bd !", "zz", "s", 4), (3, "abd", "a", "s", 3)], DOCUMENTS).where(~held_out(F.col("doc_id")))
    assert fit(docs).languages == ("a",)
    assert {r.lang_pred for r in language_id(docs.withColumn("text", F.lit("\u00bd 2"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    right = [r for r in found if r.lang == r.lang_pred]
    assert len(found) > 200 and len(right) / len(found) > 0.98
    assert abs(np.mean([r.score for r in found]) - len(right) / len(found)) < 0.05


def test_counts_do_not_depend_on_blocks(monkeypatch):
    from meshwork.llm import language_id as module

    text = prose(1, 500)
    whole = gram_counts(text)
    monkeypatch.setattr(module, "BLOCK", 64)
    parts = gram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


# URLs


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/1", "https://x.COM/fr/", "https://x.com/de/a://b", "https://org/", "https://a.org", "https://a.net?q=/x", "ÄÖ://ÄB.com/é", "http://casino-win.example.net/en/1", "http://weather-guide.example.net/en/1", "http://a\nb.com/c\nd"]
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(urls)] + [(None, "http://a.org/", None, None)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages).collect()}
    limit = url_filter.fit(url_filter.labelled_urls(spark))[1]
    for i, u in enumerate(urls):
        host, path = brute_url(u)
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best.name)
        assert got[i].verdict == (best.verdict if best else "block" if got[i].score >= limit else "allow")
    assert got[13].verdict == "block" and got[14].verdict == "allow" and got[None].rule == "org/"
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_null_pages(spark):
    pages = spark.createDataFrame([(None, None, None)] * 3, "page_id long, url string, html string")
    assert {(r.host, r.path, r.rule) for r in url_filter.filter_urls(pages).collect()} == {("", "", None)}


def test_url_model_on_names_that_it_has_not_seen(spark):
    """Precision and recall on labelled names that neither training nor the threshold has met."""
    labelled = url_filter.labelled_urls(spark)
    unseen = F.pmod(F.crc32(F.concat("name", F.lit("!")).cast("binary")), F.lit(4)) == 0
    weights, limit = url_filter.fit(labelled.where(~unseen))
    found = labelled.where(unseen).select("blocked", (url_filter.score_of(weights, url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))) >= limit).alias("said")).collect()
    hits = sum(r.blocked and r.said for r in found)
    assert len(found) > 150 and hits / sum(r.said for r in found) > 0.9 and hits / sum(r.blocked for r in found) > 0.75
    assert set(url_filter.train(url_filter._checked(labelled.limit(0), "url", "blocked"))) == {0.0}


def test_labelled_table_holds_no_judged_host(spark):
    name = lambda c: F.regexp_replace(F.regexp_extract(c, "://([^/?#]*)", 1), r"^(www|blog|m)\\.|\\.example\\..*$", "")
    judged = {r[0] for sf in ("0.01", "0.1") for r in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").select(name(F.col("url"))).distinct().collect()}
    assert judged and not judged & {r[0] for r in url_filter.labelled_urls(spark).select(name(F.col("url"))).collect()}


@pytest.mark.parametrize(("scored", "wanted"), [([], 0.5), ([(0.9, 1)], 0.5), ([(0.9, 1), (0.8, 1), (0.2, 0)], 0.5), ([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], 0.7)])
def test_best_threshold(scored, wanted):
    assert abs(url_filter.best_threshold(scored) - wanted) < 1e-9


# Tokens


def encoded(tok, text):
    return np.array(tok.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_round_trip(spark, odd, none):
    tok = tokenizer()
    texts = ODD + [(30, "".join(random.Random(1).choices(" \n\tab'sé中²٣😀.\x1c", k=700))), (31, prose(1, 3000) * 2), (32, "nospaces" * 500), (33, "’s it's 12 ½")]
    got = Counter(tuple(r) for r in bpe_round_trip(table(spark, texts)).collect())
    wanted = Counter()
    for i, t in texts:
        ids = encoded(tok, t)
        wanted[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids.tolist(), skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == wanted
    back = decode_documents(encode_documents(table(spark, texts)))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t in texts)
    assert bpe_round_trip(none).count() == 0


def test_shared_chunks_are_encoded_once(spark):
    passage = prose(2, 2000)
    texts = [(i, f"{prose(30 + i, 50 + 9 * i)} {passage} {prose(40 + i, 30)}") for i in range(5)] + [(9, prose(3, 900)), (10, prose(4, 3)), (11, prose(4, 3)), (12, "<|endoftext|>" + passage)]
    held = Counter(c for _, t in texts[:-1] for c in bpe_codec.chunks_of(t.encode(), {}))
    links, codes = bpe_codec.shared_chunks(bpe_codec._texts(table(spark, texts)), vocabulary_path())
    shared = {c for c, n in held.items() if n > 1}
    found = [(r.x, r.y) for r in codes.collect()]
    assert len(shared) > 10 and len(found) == len(set(found)) and set(found) == set(map(tuple, bpe_codec.chunk_keys(sorted(shared)).tolist()))
    assert links.count() == sum(len(shared & set(bpe_codec.chunks_of(t.encode(), {}))) for t in {t for _, t in texts[:-1]})
    tok = tokenizer()
    got = {r.doc_id: r.ids_sha256 for r in bpe_round_trip(table(spark, texts)).collect()}
    assert got == {i: hashlib.sha256(encoded(tok, t).tobytes()).hexdigest() for i, t in texts}


def test_round_trip_writes_few_files(spark, tmp_path):
    """Each file that executors write in a local folder forks them, which counts their memory twice for a moment."""
    before = shared.written(spark)
    texts = [(i, f"{prose(2, 2000)} {prose(50 + i, 40)}" if i % 2 else prose(60 + i, 90)) for i in range(40)]
    bpe_round_trip(table(spark, texts).repartition(20)).write.parquet(f"{tmp_path}/out")
    assert shared.written(spark) == before
    assert len(list(tmp_path.glob("out/*.parquet"))) == 1
    tok = tokenizer()
    got = {r.doc_id: r.ids_sha256 for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: hashlib.sha256(encoded(tok, t).tobytes()).hexdigest() for i, t in texts}


def test_token_counts(spark, odd, none):
    """Against the tokenizers library, to which added tokens' strings are ordinary text."""
    plain = tokenizer()
    plain.encode_special_tokens = True
    for block in (64, 65_536):
        got = Counter((r.doc_id, r.n_tokens) for r in token_counts.token_counts(odd.repartition(3), block=block).collect())
        assert got == Counter((i, len(encoded(plain, t))) for i, t in ODD)
    assert token_counts.token_counts(none).count() == 0


def test_separator_scan_of_any_file(spark):
    flat = [9, 0, 0, 7, 7, 7, 7, 7, 0, 5]
    blocks = [(3, k, np.array(flat[a:b], "<u4").tobytes()) for k, (a, b) in enumerate([(0, 1), (1, 3), (3, 6), (6, 6), (6, 10)])]
    got = sorted(map(tuple, token_counts.separator_scan(spark.createDataFrame(blocks, "shard long, block long, ids binary"), 0, "<u4").collect()))
    assert got == [(3, 0, 0, 1, True), (3, 1, 2, 0, True), (3, 2, 3, 5, True), (3, 3, 9, 1, False)]


# Packing


def check_packing(rows, texts, capacity):
    tok = tokenizer()
    ids = {i: np.append(encoded(tok, t), np.uint32(0)).astype("<u4") for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(pieces):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity
            assert k == 0 or r.length == capacity
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(map(len, ids.values()))


def test_packing_of_odd_rows(spark, odd):
    ids = {i: [len(encoded(tokenizer(), t)) + 1 for j, t in ODD if i == j] for i, _ in ODD}
    got = Counter()
    for r in packing.best_fit_packing(odd).collect():
        got[r.doc_id] += r.length
    assert got == {i: sum(n) for i, n in ids.items()}


def test_packing(spark, none):
    texts = [(i, prose(i, 1 + 37 * i % 300)) for i in range(150)] + [(500, None), (501, ""), (502, prose(1, 4000)), (503, "x")]
    used, total = check_packing(packing.best_fit_packing(table(spark, texts)).collect(), texts, packing.CAPACITY)
    assert used <= -(-total // packing.CAPACITY) + 1
    assert packing.best_fit_packing(none).count() == 0
    assert packing.best_fit_packing(table(spark, [(None, "a"), (None, "a"), (1, "b"), (1, "b")])).count() == 4


def test_local_search_keeps_pieces_and_saves_bins():
    lengths = {6: 40, 5: 41, 4: 13, 3: 30, 7: 22}
    start = {((7, 1),): 22, ((6, 1),): 40, ((5, 1),): 41, ((4, 1), (3, 1)): 13, ((3, 1),): 17}
    end = packing.local_search(start, 12)
    pieces = Counter()
    for p, m in end.items():
        assert 0 < packing.fill(p) <= 12
        for n, k in p:
            pieces[n] += k * m
    assert pieces == Counter(lengths)
    assert sum(end.values()) < sum(start.values()) - 40
    assert sum(packing.packed(lengths, 12).values()) == 63


def fewest(items, capacity):
    """The least number of bins, by trying every place of every item."""
    best = len(items)

    def place(k, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if k == len(items):
            best = len(gaps)
            return
        for j in {g: j for j, g in enumerate(gaps) if g >= items[k]}.values():
            place(k + 1, [*gaps[:j], gaps[j] - items[k], *gaps[j + 1 :]])
        place(k + 1, [*gaps, capacity - items[k]])

    place(0, [])
    return best


def test_packing_of_few_pieces_is_the_best():
    draws = random.Random(11)
    for _ in range(40):
        items = sorted((draws.randint(2, 11) for _ in range(10)), reverse=True)
        found = packing.packed(Counter(items), 12)
        assert Counter(n for p, m in found.items() for n, k in p for _ in range(k * m)) == Counter(items)
        assert sum(found.values()) == fewest(items, 12)
    assert packing.packed({}, 12) == {}


def test_local_search_ends_where_no_exchange_is_left():
    draws = random.Random(1)
    lengths, capacity = Counter(draws.randint(500, 1000) for _ in range(600)), 2048
    end = packing.local_search(packing.best_fit_decreasing(lengths, capacity), capacity)
    pieces = Counter()
    for p, m in end.items():
        assert 0 < packing.fill(p) <= capacity
        for n, k in p:
            pieces[n] += k * m
    assert pieces == lengths and sum(end.values()) > -(-sum(n * k for n, k in lengths.items()) // capacity)

    one = {p: {n for n, _ in p} for p in end}
    two = {p: set(map(sum, itertools.combinations([n for n, k in p for _ in range(k)], 2))) for p in end}
    for a, b in itertools.product(end, end):
        gap = capacity - packing.fill(b)
        if packing.fill(a) > packing.fill(b) or not gap or a == b and end[a] < 2:
            continue
        gains = [x - y for x in one[a] for y in {0} | one[b] | two[b]] + [x - y for x in two[a] for y in one[b]]
        assert not any(0 < g <= gap for g in gains)


# Media


def test_media(spark, odd, none):
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media_columns(odd).collect())
    wanted = Counter()
    for i, t in ODD:
        raw = (t or "").encode()
        payload = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        media = to_wav(payload)
        wanted[(i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())] += 1
    assert got == wanted
    rows = {r.doc_id: r for r in media_columns(odd).collect()}
    assert from_wav(bytes(rows[8].media)) == padded(ODD[10][1].encode())
    with wave.open(io.BytesIO(bytes(rows[8].media))) as w:
        assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
    assert rows[4].feature == rows[5].feature and list(rows[8].times) == sorted(rows[8].times) and len(rows[8].codes) > 50
    assert media_columns(none).count() == 0


def plain_fingerprint(payload):
    """Peaks and pairs from sums of sines and cosines, frame by frame."""
    size, hop, bands = 256, 128, ((1, 20), (20, 60), (60, 129))
    samples = [b - 128 for b in payload] + [0] * (size - len(payload))
    samples = [np.float32(x) for x in samples]
    hann = np.hanning(size).astype(np.float32)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(size // 2 + 1), np.arange(size)) / size)
    frames = []
    for at in range(0, len(samples) - size + 1, hop):
        strength = np.abs(turn @ (np.array(samples[at : at + size]) * hann).astype(np.float64)) ** 2
        frames.append([max((strength[f], -f) for f in range(a, b)) for a, b in bands])
    peaks = []
    for t, frame in enumerate(frames):
        for band, (power, f) in enumerate(frame):
            before = frames[t - 1][band][0] if t else -1
            after = frames[t + 1][band][0] if t + 1 < len(frames) else -1
            if power > 1e-9 and power >= before and power > after:
                peaks.append((t, -f))
    return sorted((t, f << 16 | g << 8 | u - t) for k, (t, f) in enumerate(peaks) for u, g in peaks[k + 1 : k + 4] if u - t <= 63)


def test_fingerprint_by_plain_sums(spark):
    texts = [(i, " ".join(random.Random(i).choices(["aaaa", "zz", "Q~", "\u00e9", "x y", "1234567"], k=120 * (i + 1)))) for i in range(4)]
    for r in media_columns(table(spark, texts)).collect():
        wanted = plain_fingerprint(padded(dict(texts)[r.doc_id].encode()))
        assert list(zip(r.times, r.codes)) == wanted and len(wanted) > 4
        mark = hashlib.sha256(np.array(r.times, "<i4").tobytes() + np.array(r.codes, "<i4").tobytes()).hexdigest()[:32]
        assert r.feature == f"{len(wanted)}:{mark}"


# All of them


@pytest.mark.parametrize("operator", [exact_dedup, near.near_groups, lines.line_dedup, span_dedup.span_dedup, language_id])
def test_empty_and_odd_tables(odd, none, operator):
    assert operator(none).count() == 0
    assert operator(odd).count() == len(ODD)


def test_all_null_table(spark):
    rows = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCUMENTS)
    for operator in (exact_dedup, near.near_groups, lines.line_dedup, span_dedup.span_dedup, language_id, packing.best_fit_packing, bpe_round_trip, token_counts.token_counts, media_columns):
        assert operator(rows).count() == 3


def brute_pipeline(texts):
    """Rows after the stages before packing, by the plain versions above; letterless texts have no language."""
    one = {i: t for i, t in texts if t and any(map(str.isalpha, t))}
    step = lambda found: {i: t for (i, t), _ in found.items() if one[i] == t or t.strip()}
    one = step(brute_lines(sorted(one.items()), lines.MIN_WORDS))
    rows = sorted(one.items())
    one = {i: one[i] for i, _, _, kept in brute_components(rows, near.Near(words=5, percent=80)) if kept or not one[i].split()}
    return step(brute_spans(sorted(one.items()), span_dedup.Spans()))


def stages(spark, docs, folder):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def test_pipeline_against_brute_force(spark, tmp_path):
    draws = random.Random(13)
    pool = [f"{prose(100 + k, draws.randrange(4, 22)).capitalize()}." for k in range(60)]
    passage = " ".join(pool[:6])
    texts = []
    for i in range(50):
        body = draws.choice((" ", "\n")).join(draws.choices(pool[6:], k=draws.randrange(3, 12)))
        body = f"{body} {passage} {prose(i, 12)}" if i % 6 == 1 else body
        texts.append((i, body if i % 7 else texts[i - 3][1].replace("w1", "w2", 1) if i > 3 else body))
    texts += [(90, "12 34"), (91, None), (92, ""), (93, texts[5][1]), (94, texts[8][1] + " w9 w8")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in texts], DOCUMENTS + ", node string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/stages")
    wanted = brute_pipeline(texts)
    assert {r.doc_id: r.text for r in docs.collect()} == wanted and 20 < len(wanted) < 52
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), list(wanted.items()), packing.CAPACITY)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_pipeline_of_empty_and_null_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    passage = " ".join(f"{prose(s, 20).capitalize()}." for s in range(40, 44))
    near_a = prose(70, 200)
    near_b = near_a.replace(" ", "  ", 3).rsplit(" ", 3)[0] + " changed"
    texts = [(1, prose(60, 80)), (2, "12 34"), (3, None), (4, "first line here is long\nsecond line is short\n" + prose(61, 40)), (5, prose(62, 40) + "\nfirst line here is long\nsecond line is short"), (6, near_a), (7, near_b), (8, f"{prose(63, 40)} {passage} {prose(64, 20)}"), (9, f"{prose(65, 40)} {passage} {prose(66, 20)}")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {1: texts[0][1], 4: texts[3][1], 5: prose(62, 40), 6: near_a, 8: texts[7][1], 9: f"{prose(65, 40)} {prose(66, 20)}"}
    docs = stages(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/stages")
    assert {r.doc_id: r.text for r in docs.collect()} == wanted
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), list(wanted.items()), packing.CAPACITY)


def held_mb(pid="self"):
    return int(re.search(r"Anonymous:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


@pytest.mark.parametrize("step", [prepare, lambda spark: materialize(spark.range(1), "one"), memory.hand_back])
def test_driver_hands_back_what_it_has_freed(spark, monkeypatch, step):
    monkeypatch.setattr(memory, "EVERY", -1)
    c = ctypes.CDLL(None)
    c.malloc.restype, c.malloc.argtypes, c.free.argtypes = ctypes.c_void_p, [ctypes.c_size_t], [ctypes.c_void_p]
    own = [c.malloc(20_000) for _ in range(5000)]
    for at in own:
        ctypes.memset(at, 1, 20_000)
    full = held_mb()
    for at in own[:-1]:  # the last one keeps the rest from going by itself
        c.free(at)
    assert held_mb() > full - 20
    step(spark)
    c.free(own[-1])
    assert held_mb() < full - 60


def test_jvm_hands_back_what_it_has_freed(spark):
    java, pid = spark._jvm.org.apache.spark.unsafe.Platform, int(spark._jvm.java.lang.ProcessHandle.current().pid())
    own = [java.allocateMemory(100_000) for _ in range(1000)]
    for at in own:
        java.setMemory(at, 1, 100_000)
    full = held_mb(pid)
    for at in own[:-1]:
        java.freeMemory(at)
    assert held_mb(pid) > full - 20
    memory.hand_back(spark)
    java.freeMemory(own[-1])
    assert held_mb(pid) < full - 60


def test_sample_travels_in_few_bytes(spark, monkeypatch):
    seen = []
    to_arrow = type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda self: seen.append(self.dtypes) or to_arrow(self))
    text = "ein Satz " * 40_000
    (lang, slots, counts), *_ = sample(table(spark, [(1, text)], "de"), 5)
    assert lang == "de" and [x.tolist() for x in (slots, counts)] == [x.tolist() for x in gram_counts(text)] and counts.max() > 32767
    assert dict(seen[-1])["slots"] == "array<smallint>" and dict(seen[-1])["counts"] == "array<int>"

"""Operators against brute force, exact round trips and planted cases, with nulls, blanks, ties and repeats."""

import io
import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulight.llm import (
    decontaminate, jaccard_join, kd_search, language_id, licenses, lm_scoring, pieces, quality, sampling, transcripts, warc,
)
from tabulight.llm.queries import model_path
from tabulight.llm.words import shingle_sets, word_hashes

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "vu", "ze") for b in ("n", "ri", "st", "lum", "dor")]
DOCS = "doc_id long, text string, lang string, score string, body string"


def prose(seed, count):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(count))


def documents(spark, texts):
    """Texts with ids from 0, a null id, a repeated row, and columns whose names clash."""
    rows = [(i, t, "xx", "s", "b") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], (None, texts[0], None, None, None)], DOCS)


def test_words_are_split_and_lowered():
    parts = [b"A bC\x0bd\xc3\x89 \n", b"", b"bc a"]
    hashes, edges = word_hashes(parts)
    assert edges.tolist() == [0, 3, 3, 5]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def brute_components(texts, words, percent):
    sets = []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        grams = {tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)} or ({tuple(tokens)} if tokens else set())
        sets.append(grams)
    label = list(range(len(texts)))
    for _ in texts:
        for a, b in itertools.combinations(range(len(texts)), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    return [len(s) for s in sets], label


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, words, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 5)
    rng = random.Random(words)
    texts = [None, "", "  \n ", "one two", "one TWO", "x"]
    for seed in range(12):
        base = prose(seed, 60).split()
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    sizes, labels = brute_components(texts, words, percent)
    found = jaccard_join.jaccard_components(documents(spark, texts), words=words, percent=percent).collect()
    named = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}
    assert len(found) == len(texts) + 2 and named.pop(None)[1] is None
    assert named == {i: (s, c) for i, (s, c) in enumerate(zip(sizes, labels, strict=True))}
    kept = jaccard_join.keep_one(documents(spark, texts), "doc_id", "text", words, percent)
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(labels))
    assert kept.columns == ["doc_id", "text", "lang", "score", "body"]


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for char in text:
        new = [0]
        for i in range(1, len(item) + 1):
            new.append(min(row[i - 1] + (item[i - 1] != char), row[i] + 1, new[i - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_matcher_equals_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 40)))
        part = list(item)
        for _ in range(rng.randint(0, 6)):
            if part:
                place = rng.randrange(len(part))
                part[place : place + 1] = rng.choice(["", "a", "bc"])
        text = "".join(rng.choice("abc") for _ in range(20)) + "".join(part) + "cab"
        found = decontaminate.Matcher([(7, item)], 0.15).find(text)
        distance = edit_distance(item, text)
        assert (distance <= int(len(item) * 0.15)) == bool(found)
        assert not found or found[0][1] == distance


def test_contaminated(spark):
    item = prose(90, 30)
    edited = item.replace(" ", "  ", 3).upper()[:-3] + "?"
    docs = documents(spark, [f"{prose(1, 20)} {edited} end", prose(2, 80), None, ""])
    items = spark.createDataFrame([(5, item), (6, None), (7, ""), (None, prose(2, 40))], "item_id long, text string")
    found = decontaminate.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(0, 5), (None, 5)}
    kept = decontaminate.drop_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "LEAF_ROWS", 8)
    monkeypatch.setattr(kd_search, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(kd_search, "FIRST_LOOK", 30)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=3), 1)], "c") for i in range(200)]
    bad = [(300, None, ""), (301, [1.0, None, 2.0], ""), (302, [1.0, float("nan"), 0.0], ""), (None, [9.0] * 3, ""), (303, [5.0], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score string")
    found = kd_search.top_k(df, df.filter("vec_id % 20 = 0"), k=7).collect()
    vectors = {i: np.floor(64 * np.array(v)).astype(int) for i, v, _ in rows}
    for query in range(0, 200, 20):
        scores = sorted((-int(v @ vectors[query]), i) for i, v in vectors.items() if i != query)[:7]
        got = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == query)
        assert got == [(p, i, -s) for p, (s, i) in enumerate(scores, 1)]
    assert kd_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_lm_scores(spark):
    texts = [prose(s % 7, 30) for s in range(40)] + [None, "", "zzz unseen zzz"]
    found = {r["doc_id"]: r for r in lm_scoring.lm_score(documents(spark, texts)).collect() if r["doc_id"] is not None}
    import binascii
    from collections import Counter

    tokens = [[*(t or "").lower().split(), None] for t in texts]
    train = [i for i in range(len(texts)) if binascii.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for i in [*train, *([0] if 0 in train else [])] for w in tokens[i])
    total, kinds = sum(counts.values()), len(counts)
    for i, words in enumerate(tokens):
        row = found[i]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        assert row["train_tokens"] == total and row["n_tokens"] == len(words)
        assert row["n_known"] == sum(counts[w] > 0 for w in words)
        assert row["base_score"] == pytest.approx(base) and row["held_out"] == (i not in train)
    held = [r for i, r in found.items() if r["held_out"] and texts[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.lm_score(documents(spark, texts).limit(0)).count() == 0


def test_filter_reads_levels_back():
    grams = np.random.default_rng(1).integers(0, 2**63, 4000).astype(np.uint64)
    counts = np.random.default_rng(2).zipf(1.7, 4000).clip(1, 10**6)
    bits = lm_scoring.filter_bits(grams, counts)
    known = lm_scoring.Filter(bits, np.zeros((2, 1), np.int64), np.full((2, 1), len(bits)))
    levels = known.levels(grams, 0)
    assert (levels >= lm_scoring.level(counts)).all()
    assert (levels == lm_scoring.level(counts)).mean() > 0.9
    assert (known.levels(grams + np.uint64(1), 0) == 0).mean() > 0.9


def test_quality_learns_and_takes_anything(spark):
    texts = [prose(s, 40) if s % 2 else "!!! ".join(["SPAM"] * 30) + str(s) for s in range(120)] + [None, "", " "]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = [r for r in quality.quality(docs, labels).collect()]
    assert len(rows) == len(texts) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    assert held and all(r["predicted"] == r["doc_id"] % 2 for r in held)
    assert quality.quality(docs, labels.limit(0)).agg(F.avg("score")).first()[0] == 0.5


def test_language_models(spark):
    english = "the weather was fine and they went home with their friends after dinner in town"
    german = "das wetter war schön und sie gingen nach dem essen mit ihren freunden nach hause"
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = (english if i % 2 else german).split()
        rows.append((i, " ".join(rng.choice(words) for _ in range(25)), "en" if i % 2 else "de"))
    rows += [(900, None, "en"), (901, "", None), (902, "123 !?", "de"), (903, "漢字仮名交じり文" * 40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language_id.language_id(df).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "de") and not found[i]["rejected"] for i in range(120))
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (900, 901, 902))
    assert found[903]["rejected"]
    models = language_id.train(df)
    chars = [language_id.letters(c.encode() + b"a") for c in "abc"]
    points, ends, _ = language_id.padded(chars)
    assert np.isfinite(models.log_probs(points, ends)).all()
    assert language_id.language_id(df.limit(0)).count() == 0


def test_pieces_give_texts_back_at_the_best_score():
    model = pieces.load_model(model_path())
    texts = ["  a  b\n\n c▁d ", "日本語 🎉🎉 x", "\x00\x01", " ", "\n", "", "The quick Brown foxes' jumping"]
    for text, ids in zip(texts, pieces.encode_batch(model, [t.encode() for t in texts]), strict=True):
        assert pieces.decode_ids(model, ids.tolist()).decode() == text
    scores = {t: model.score[s] for s, t in ((s, model.texts[p]) for s, p in enumerate(model.piece) if p >= 0)}
    rng = random.Random(5)
    for _ in range(60):
        word = b" " + "".join(rng.choice("thequickanoérs漢") for _ in range(rng.randint(1, 9))).encode()
        text = word.decode()
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                piece = text[start:end].encode()
                value = scores.get(piece, model.unknown_score if end - start == 1 else -1e18)
                best[end] = max(best[end], best[start] + value)
        ids = pieces.segment_ids(model, [word])[0]
        bytewise = {int(b) for b in model.byte_ids}
        got = sum(scores[model.texts[i]] for i in ids.tolist() if i not in bytewise)
        unknown = [c for c in pieces.decode_ids(model, [i for i in ids.tolist() if i in bytewise]).decode()]
        assert got + len(unknown) * model.unknown_score == pytest.approx(best[-1])


def test_long_segments_take_the_same_path_in_linear_time(monkeypatch):
    model = pieces.load_model(model_path())
    rng = random.Random(8)
    signs = "漢字仮名交文日本語東京大学の学生は毎朝電車で通う一二三aé🎉"
    long = "".join(rng.choice(signs) for _ in range(700)) + "=" * 90 + "a" * 300 + "thequickbrownfoxjumps" * 9
    segments = [long.encode(), b" the", "漢".encode(), b"", b"\xe6\xbc", long[40:90].encode(), b"x"]
    ids, starts = pieces.wide_ids(model, segments)
    for i, segment in enumerate(segments):
        assert pieces.lone_ids(model, segment).tolist() == ids[starts[i] : starts[i + 1]].tolist()
    for width in (1, 3, 64):
        monkeypatch.setattr(pieces, "WIDTH", width)
        mixed, edges = pieces.segment_ids(model, segments)
        assert mixed.tolist() == ids.tolist() and edges.tolist() == starts.tolist()
    page = "".join(rng.choice(signs) for _ in range(360_000)).encode()
    assert len(page) > 1_000_000
    before = time.perf_counter()
    found = pieces.encode_batch(model, [page])[0]
    assert time.perf_counter() - before < 10
    assert pieces.decode_ids(model, found.tolist()) == page


@pytest.mark.parametrize("most_rows, most_bytes", [(10, 10**6), (40, 300), (10**6, 10**6), (0, 5), (700, 2500)])
def test_bounded_sample_equals_a_full_sort(spark, most_rows, most_bytes, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"l{i % 4}", i % 7) for i in range(900)] + [(5, "hot", 5), (5, "hot", 2)]
    df = spark.createDataFrame(rows, "id long, label string, size long").withColumn("hash", F.xxhash64("id"))
    want = set()
    for label in {r[1] for r in rows}:
        ordered = sorted((r["hash"], r["id"], r["size"]) for r in df.collect() if r["label"] == label)
        so_far = np.cumsum([r[2] for r in ordered])
        want |= {(r[1], label) for r, s in zip(ordered[:most_rows], so_far, strict=False) if s <= most_bytes}
    source = df.select("id", "label", "size")
    for bits in (10, 2):
        monkeypatch.setattr(sampling, "LEVEL_BITS", bits)
        found = sampling.bounded_sample(source.repartition(5), "label", most_rows, most_bytes).collect()
        got = [tuple(r) for r in found]
        assert len(got) == len(set(got))
        # rows of one id may come in any order, so a bound may fall between them
        assert {g for g in got if g[0] != 5} == {w for w in want if w[0] != 5}
    assert sampling.bounded_sample(source.limit(0), "label", most_rows, most_bytes).count() == 0


def test_encode_and_decode_frames(spark):
    texts = [prose(1, 30), None, "", "tab\there\nnew  line "]
    coded = pieces.encode(documents(spark, texts), model_path(), keep_text=True)
    back = pieces.decode(coded, model_path())
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect()) and back.count() == len(texts) + 2


def test_zip_reader_and_ranges():
    pages = [{"page_id": i, "url": f"http://x/{i}\n", "body": b"<p>%d</p>" % i * 50, "digest": "", "refers_to": None} for i in range(3)]
    for page in pages:
        import hashlib

        page["digest"] = hashlib.sha256(page["body"]).hexdigest()
    for force in (False, True):
        data = warc.package([(p["page_id"], warc.record(p)) for p in pages], force_zip64=force)
        rows = list(warc.read_archive(io.BytesIO(data), len(data)))
        assert [(r["page_id"], r["payload"]) for r in rows] == [(p["page_id"], p["body"]) for p in pages]
    start, count = 1 << 33, 5
    assert warc.wide_fields(b"\x01\x00\x10\x00" + start.to_bytes(8, "little") + count.to_bytes(8, "little")) == [start, count]
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"x" * 100), 100)


def test_warc_round_trip(spark):
    long = "<p>é</p>" * 30
    rows = [(3, "u", long), (1, None, long), (2, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (2, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(df).collect()))
    size = len(long.encode())
    assert found == [
        (0, "response", None, size), (1, "response", None, size), (2, "revisit", 1, size), (2, "revisit", 1, size),
        (3, "revisit", 1, size), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0),
    ]
    assert warc.round_trip(df.limit(0)).count() == 0


def test_license_scan(spark):
    mit = "Copyright (c) 2020 Some One\n" + licenses.MIT_TERMS.replace("sublicense", "Sublicense").replace(",", " ,")
    texts = [mit, "text\nReleased under the MIT licence!", None, "", "...", "nothing"]
    found = {r["doc_id"]: r for r in licenses.scan(documents(spark, texts), licenses.known_digests(spark)).collect()}
    assert found[0]["license_id"] == "MIT" and found[1]["notice_ids"] == "MIT" and found[1]["license_id"] is None
    assert found[2]["text_digest"] is None and found[3]["text_digest"] is None and found[4]["text_digest"] is None
    assert found[5]["n_notices"] == 0 and None in found


def test_transcripts(spark):
    rows = []
    for conv in range(60):
        for turn in range(6):
            role = "user" if turn % 2 == 0 else "assistant"
            body = f"what is {prose(conv, 3)}?" if role == "user" else f"it is {prose(conv * 9 + turn, 30)}.\n{prose(turn, 25)}."
            rows.append((conv, turn, role, body))
    rows += [(900, t, "user", f"line {t}") for t in range(700)] + [(900, 3, "user", "line 3"), (None, None, None, None), (901, 0, "user", "")]
    found = transcripts.chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    plain = [r for r in found if r["conv_id"] is not None and r["conv_id"] < 60]
    assert sum(r["n_right"] for r in plain) > 0.95 * sum(r["n_lines"] for r in plain)
    long = sorted((r for r in found if r["conv_id"] == 900), key=lambda r: r["part"])
    assert len(long) >= 3 and sum(r["n_lines"] for r in long) >= 2 * 701
    assert "<|user|>" in plain[0]["rendered"]
    model = transcripts.Model(*(np.zeros(s) for s in (6, (6, 6), (6, transcripts.SYMBOLS))))
    assert transcripts.parse(model, None) == ([], []) and transcripts.parse(model, "  \n") == ([], [])


ODD = "pick one\nA: red\nAnswer: 5\n# Instructions\n\n  user: x \nend of it"


def test_only_markers_of_opening_lines_go(spark):
    """Lines that look like markers inside a turn stay, blanks too; every style gives the text back byte by byte."""
    texts = [ODD, "", " two  blanks ", "\nstarts blank", "ends blank\n", "?", "a\n\n\nb"]
    for conv in range(5):
        for turn, text in enumerate(texts):
            lines, states = transcripts.written_turn(conv, turn, "assistant", text)
            rest, turns = transcripts.cut(lines, states, None)
            own = turns[0][1] if (conv * 31 + turn * 7) % 5 else [lines[0], *lines[1:-1]]
            assert rest == [] and len(turns) == 1 and "\n".join(own) == text, (conv, turn)


def test_a_long_conversation_is_decoded_as_one(spark, monkeypatch):
    """1,000 turns in slices of 16 rows over several partitions: states and rendering as of one decode."""
    monkeypatch.setattr(transcripts, "SLICE_ROWS", 16)
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x", None]), rng.choice([ODD, "hi there?", prose(t, 9), ""])) for c, n in ((7, 1000), (3, 40), (None, 20)) for t in range(n)]
    rows += rows[:30] + [(7, None, "user", "no turn"), (3, 5, None, None)]
    written = transcripts.stage(transcripts.written_out(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    gen = np.random.default_rng(4)
    model = transcripts.Model(gen.normal(size=6), gen.normal(size=(6, 6)) * 3, gen.normal(size=(6, transcripts.SYMBOLS)))
    found = transcripts.parse_slices(written, model).collect()
    texts = {}
    for r in sorted(written.collect(), key=lambda r: r["part"]):
        texts.setdefault(r["conv_id"], []).append(r["text"])
    assert sum(len(t) for t in texts.values()) == len(found) > 60
    for conv, parts in texts.items():
        own = sorted((r for r in found if r["conv_id"] == conv), key=lambda r: r["part"])
        line_roles, turns = transcripts.parse(model, "\n".join(parts))
        assert [x for r in own for x in r["line_roles"]] == line_roles
        assert "".join(r["rendered"] for r in own) == transcripts.rendered(turns)
        assert [x for r in own for x in r["roles"]] == [role for role, _ in turns]
    assert transcripts.chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string, part string")).collect() == []


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(6)
    model = transcripts.Model(rng.normal(size=6), rng.normal(size=(6, 6)), rng.normal(size=(6, transcripts.SYMBOLS)))
    symbols = rng.integers(0, transcripts.SYMBOLS, 5)

    def score(path):
        total = model.first[path[0]] + model.show[path[0], symbols[0]]
        for before, now, symbol in zip(path, path[1:], symbols[1:], strict=False):
            total += model.move[before, now] + model.show[now, symbol]
        return total

    assert max(itertools.product(range(6), repeat=5), key=score) == tuple(model.decode(symbols).tolist())


def test_shingle_order_does_not_change_sets():
    text = prose(1, 200).encode()
    hashes = np.sort(np.unique(word_hashes([text])[0]))
    plain = next(shingle_sets([text], 4, (hashes[:0], np.zeros(0, np.int64))))
    ranked = next(shingle_sets([text], 4, (hashes[:9], np.full(9, 20))))
    assert len(plain) == len(ranked) and (np.diff(ranked.astype(object)) > 0).all()


def test_pipeline_stages_keep_and_drop(spark, tmp_path):
    import corpus_pipeline

    good = [prose(s, 60) for s in range(60)]
    item = prose(501, 40)
    texts = [*good, good[0] + " extra", "!!! ".join(["SPAM"] * 40), None, f"{prose(700, 20)} {item} {prose(701, 20)}"]
    texts += ["!!! ".join(["JUNK", "SPAM"] * 20) + f" X{i}" for i in range(20)]
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 60)) for i in range(len(texts)) if i < 60 or i > 63]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in kept) == list(range(60)) and all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in kept)

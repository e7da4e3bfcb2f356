import random

import numpy as np

from tantu.llm import leaks
from tests.conftest import rows

DOC = "doc_id long, text string, item_id string, hits string, score string"
ITEM = "item_id long, text string, lang string, task string"
VOCABULARY = [a + b for a in ("kar", "tol", "min", "sev", "bor", "ael", "Ṛg", "dhā", "Éla") for b in ("an", "ith", "ovu", "ās", "em", "ur", "ṣi")]


def sentence(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], DOC)


def items(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "qa") for i, t in enumerate(texts)], ITEM)


def brute(texts, listed, least=leaks.WORDS):
    found = set()
    for d, text in enumerate(texts):
        own = leaks.words(text or "")
        for i, item in enumerate(listed):
            w = leaks.words(item or "")
            for k in range(len(w) - least + 1):
                run = w[k : k + least]
                if any(own[j : j + least] == run for j in range(len(own) - least + 1)):
                    found.add((d, i))
    return found


def test_runs_are_found_as_by_comparing_everything(spark):
    rng = random.Random(1)
    listed = [" ".join(sentence(rng, rng.randint(8, 40))) for _ in range(25)]
    texts = []
    for _ in range(120):
        before, after = sentence(rng, rng.randint(0, 30)), sentence(rng, rng.randint(0, 30))
        w = rng.choice(listed).split()
        n = rng.choice([6, 9, 10, 11, 40])
        at = rng.randrange(max(1, len(w) - n + 1))
        piece = w[at : at + n]
        if rng.random() < 0.3 and len(piece) > 4:
            piece[rng.randrange(len(piece))] = "other"
        texts.append(" ".join(before + piece + after))
    want = brute(texts, listed)
    assert 20 < len(want) < 120
    assert rows(leaks.leaked(documents(spark, texts), items(spark, listed))) == want
    assert rows(leaks.alignments(documents(spark, texts), items(spark, listed)).where("run").select("doc_id", "item_id")) == want


def test_disguised_copies(spark):
    item = "Often Maunjīna sells his market near the copy of that old river beside this temple"
    copies = [item.upper(), item.lower().replace("ī", "i"), item.replace(" ", " "), "> " + item[:40] + "\n> " + item[40:], item.replace("a", "а"), item.replace("e", "e​"), item.replace(" ", " , "), "Xx " + item.replace("market", "mar-\nket") + " yy"]
    short = " ".join(item.split()[:9])
    texts = [*copies, short, "prefix" + " ".join(item.split()[:10])[1:] + "suffix", None, "", "x " * 50_000 + item]
    assert rows(leaks.leaked(documents(spark, texts), items(spark, [item]))) == {(i, 0) for i in [*range(len(copies)), len(texts) - 1]}


def test_chinese_runs(spark):
    item = "北商愚心所榮橋及剛門若厚橋善馬北門其長徒若古山其空舟"
    texts = ["天地" + item[3:19] + "玄黃", item[3:18], item[:8] + "，\n" + item[8:17], "X" + item]
    assert rows(leaks.leaked(documents(spark, texts), items(spark, [item], "zh"))) == {(0, 0), (2, 0), (3, 0)}
    assert rows(leaks.leaked(documents(spark, texts), items(spark, [item], None))) == {(0, 0), (2, 0), (3, 0)}


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (leaks.MATCH if a[i - 1] == b[j - 1] else leaks.MISMATCH), h[i - 1, j] + leaks.GAP, h[i, j - 1] + leaks.GAP)
    return int(h.max())


def test_alignment_score_is_smith_watermans():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("abcde") for _ in range(rng.randint(0, 14))]
        score, equal, _, _ = leaks.align(a, b)
        assert score == (smith_waterman(a, b) if a and b else 0)
        assert equal * leaks.MATCH >= score


def test_an_edited_copy_scores_without_being_a_run(spark):
    rng = random.Random(3)
    w = sentence(rng, 30)
    edited = [x if k % 7 else "changed" for k, x in enumerate(w)]
    found = leaks.alignments(documents(spark, [" ".join(edited)]), items(spark, [" ".join(w)])).collect()
    assert [(r.run, r.equal) for r in found] == [(False, 25)]


def test_an_edited_copy_beside_a_full_one_is_aligned(spark):
    rng = random.Random(3)
    w = sentence(rng, 30)
    edited = [x if k % 7 else "changed" for k, x in enumerate(w)]
    texts = [" ".join(edited), " ".join(w), " ".join(w), " ".join(sentence(rng, 60))]
    found = leaks.alignments(documents(spark, texts), items(spark, [" ".join(w)])).collect()
    assert sorted((r.doc_id, r.run, r.equal) for r in found) == [(0, False, 25), (1, True, 30), (2, True, 30)]
    assert rows(leaks.leaked(documents(spark, texts), items(spark, [" ".join(w)]))) == {(1, 0), (2, 0)}


def test_every_window_has_a_seed_and_rare_ones_win(spark):
    """Of the windows of an item that stands whole in many documents, the seeds are n-grams that few others hold."""
    rng = random.Random(5)
    w = sentence(rng, 24)
    common = [" ".join(w[:6] + sentence(rng, 20)) for _ in range(40)]
    docs, listed = documents(spark, [" ".join(w), *common]), items(spark, [" ".join(w)]).selectExpr("item_id", "text", "lang", "1L as item")
    pairs = {r.doc_id: len(r.grams) for r in leaks.seeded_pairs(docs, listed, leaks.GRAM, True).collect()}
    assert set(pairs) == {0}


def test_hashes_of_runs_do_not_depend_on_their_place():
    rng = random.Random(9)
    text = "".join(rng.choice("abcdeशक火") for _ in range(300))
    for n in (1, 4, 7, 8, 13, 20):
        found = leaks.gram_hashes(text, n)
        assert len(found) == 301 - n and all(found[k] == leaks.gram_hashes(text[k : k + n], n)[0] for k in range(0, 301 - n, 11))
        assert len(set(found.tolist())) == len({text[k : k + n] for k in range(301 - n)})
    assert len(leaks.gram_hashes("ab", 3)) == 0


def test_a_run_of_exactly_ten_words_with_broken_and_joined_words(spark):
    rng = random.Random(4)
    w = sentence(rng, 10)
    broken = " ".join([*w[:4], w[4][:3] + "-\n" + w[4][3:], *w[5:]])
    texts = [f"Before {broken} after", "".join(w), "X " + " ".join(w[:5]) + "".join(w[5:]) + " y", " ".join(w[:9])]
    assert rows(leaks.leaked(documents(spark, texts), items(spark, [" ".join(w)]))) == {(0, 0), (1, 0), (2, 0)}


def test_edited_copies_are_found_as_by_aligning_everything(spark):
    """Recall of edited copies against all pairs of documents and items, every third to twelfth word changed or gone."""
    rng = random.Random(11)
    listed = [" ".join(sentence(rng, 40)) for _ in range(12)]
    texts = []
    for k in range(150):
        w = rng.choice(listed).split()
        step = rng.randint(3, 12)
        kept = [x for i, x in enumerate(x if i % step else rng.choice(["changed", ""]) for i, x in enumerate(w)) if x]
        texts.append(" ".join(sentence(rng, 15) + kept + sentence(rng, 15)) if k % 3 else " ".join(sentence(rng, 50)))
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(listed):
            equal = leaks.align(leaks.words(item), leaks.words(text))[1]
            if equal / 40 >= leaks.SHARE:
                want.add((d, i))
    got = rows(leaks.alignments(documents(spark, texts), items(spark, listed)).select("doc_id", "item_id"))
    assert len(want) > 70 and got <= want and len(got) >= 0.9 * len(want)


def test_empty_tables_repeats_and_nulls(spark):
    item = " ".join(sentence(random.Random(2), 12))
    assert leaks.leaked(documents(spark, []), items(spark, [item])).count() == 0
    assert leaks.leaked(documents(spark, [item]), items(spark, [])).count() == 0
    assert leaks.leaked(documents(spark, [item]), items(spark, [None, "", "too short"])).count() == 0
    twice = documents(spark, [item]).union(documents(spark, [item]))
    assert rows(leaks.leaked(twice, items(spark, [item]).union(items(spark, [item])))) == {(0, 0)}

import base64
import random

from tantu.llm import quality
from tests.conftest import rows

DOC = "doc_id long, text string, kind string, words string, votes string"
NOUNS = [a + b for a in "riv pal merch sandal light daugh chap fest eleph garl comm herm".split() for b in "er ace ant ning ter ival and".split()]
VERBS = [v + "s" for v in "sell guard watch forgive honour praise copy escape reveal carve quote answer bind free".split()]
SANSKRIT = [a + b + c for a in "स्मौता नाश्द क्षान्नु गमुर्लि हीत्छ त्येश्फ पुसिश्ज क्षैहा आलीदी".split() for b in "भ्र प्र त्र र्ज".split() for c in "म् स्य ेषु ाय".split()]


def prose(rng):
    n = rng.randint(4, 30)
    if rng.random() < 0.3:
        return "\n".join(" ".join(rng.choice(SANSKRIT) for _ in range(rng.randint(6, 10))) + rng.choice([" ।", " ॥", ""]) for _ in range(n))
    said = [f"The {rng.choice(NOUNS)} {rng.choice(VERBS)} his {rng.choice(NOUNS)} near the {rng.choice(NOUNS)} of that {rng.choice(NOUNS)}" for _ in range(n)]
    text = rng.choice([". ", ".\n", " ", "; "]).join(said)
    if rng.random() < 0.3:
        w = text.split()
        text = "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9))
    if rng.random() < 0.2:
        text += "\n- one thing\n- another thing\n- a third"
    return text


def listing(rng):
    n, mark = rng.randint(6, 40), rng.choice(["- ", "* ", "", "• ", "№"])
    item = lambda k: (f"{k + 1}. " if mark == "№" else mark) + rng.choice(NOUNS) + rng.choice(["", f": {rng.choice(NOUNS)}", f", {rng.randint(1, 30)}.{rng.randint(1, 90)}; {rng.randint(1, 30)}.{rng.randint(1, 90)}"])
    return rng.choice(["", "The river guards the palace of the merchant in this chapter of words.\n"]) + "\n".join(item(k) for k in range(n))


def tabular(rng):
    n, k, mark = rng.randint(5, 30), rng.randint(3, 6), rng.choice([",", "\t", "|", " ; ", "aligned"])
    cells = [[rng.choice([rng.choice(NOUNS), f"{rng.random() * 100:.1f}%", str(rng.randint(1, 9999))]) for _ in range(k)] for _ in range(n)]
    return "\n".join("".join(c.ljust(20) for c in row) if mark == "aligned" else mark.join(row) for row in cells)


def junk(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return base64.b64encode(rng.randbytes(400)).decode()
    if kind == 1:
        return rng.choice(["\n", " ", " | "]).join(["Please try again later!"] * rng.randint(12, 60))
    if kind == 2:
        return "".join(rng.choice("!@#$%^&*()_+-=[]{};:,.<>/?\\|~123 \n") for _ in range(400))
    if kind == 3:
        return " ".join(rng.choice(SANSKRIT) for _ in range(30)).encode().decode("latin-1")
    if kind == 4:
        return " ".join("The river guards the palace of the merchant near the old temple")
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz1|!0") for _ in range(rng.randint(2, 9))) for _ in range(60))


def test_types_of_generated_texts(spark):
    rng = random.Random(12)
    made = [(kind, make(rng)) for kind, make, n in (("prose", prose, 500), ("list", listing, 90), ("table", tabular, 90), ("junk", junk, 90)) for _ in range(n)]
    df = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, (_, t) in enumerate(made)], DOC)
    found = {r.doc_id: r.kind for r in quality.text_types(df).collect()}
    wrong = [(made[i][0], k, made[i][1][:80]) for i, k in found.items() if k != made[i][0]]
    assert len(wrong) <= 0.03 * len(made), wrong[:10]
    assert rows(quality.not_prose(df)) == {(i, k) for i, k in found.items() if k != "prose"}


def test_statistics_of_a_known_text():
    s = dict(zip(quality.STATS, quality.statistics("The king, of old.\nA dog\n\nno 12"), strict=True))
    assert (s["words"], s["lines"], s["ends"]) == (8, 3, 1 / 3)
    assert s["digits"] == 2 / 22 and s["symbols"] == 2 / 22
    assert s["common"] == 4 / 8
    assert abs(s["mean_word"] - 22 / 8) < 1e-9


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "a", "​", "𝒳" * 10, "word " * 200_000, "\x00", "퟿"]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], DOC)
    found = {r.doc_id: r.kind for r in quality.text_types(df).collect()}
    assert set(found) == set(range(1, len(texts)))
    assert found[1] == found[2] == found[6] == "junk"
    assert quality.text_types(df.limit(0)).count() == 0
    assert quality.text_types(df.where("doc_id = 3").union(df.where("doc_id = 3"))).count() == 2


def test_learning_moves_rates_towards_agreement():
    n = len(quality.FUNCTIONS)
    own = [k for k, _ in quality.FUNCTIONS]
    pattern = lambda kind, off=(): "".join("1" if k == kind and i not in off else "0" for i, k in enumerate(own))
    silent = own.index("table")
    patterns = [(pattern("prose"), 900), (pattern("list"), 60), (pattern("table", {silent}), 60), (pattern("junk"), 60)]
    share, fires, post = quality.learn(patterns)
    assert [quality.KINDS[int(post[p].argmax())] for p, _ in patterns] == ["prose", "list", "table", "junk"]
    others = [i for i in range(n) if own[i] == "table" and i != silent]
    assert fires[2, silent] < min(fires[2, i] for i in others)
    assert abs(share.sum() - 1) < 1e-9 and share[0] > 0.7
    assert quality.learn([])[2] == {}

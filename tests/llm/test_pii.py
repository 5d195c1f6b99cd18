import hashlib
import random
import re

import pytest

from beaconaudit.llm import pii
from tests.llm.conftest import edge_rows, sentence

PLAIN = {"email": "j.doe+x@mail3.example.com", "ip": "169.122.221.182", "card": "4845168114407329", "phone": "+1 (017) 555-7713"}


def digits(text):
    return re.sub("[^0-9]", "", text)


def plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab@.12 -+()9@..é") for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [" ".join(rng.choice([*PLAIN.values(), "a@b.c@d.ef", "1.2.3.4.5", "4845-1681-1440-7329", "256.1.1.1"]) for _ in range(4)) for _ in range(50)]
    assert [pii.base_spans(t) for t in texts] == [plain(t) for t in texts]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + "-" * 300_000, "1 " * 150_000, "@" * 300_000, "(1" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def weight():
    rng = random.Random(1)
    rows = [(k, sentence(rng, 6) + " ", s, " " + sentence(rng, 6)) for k, s in PLAIN.items() for _ in range(15)]
    return pii.train(rows)


def test_held_out_spellings(weight):
    rng = random.Random(77)
    right = wrong = extra = 0
    for _ in range(80):
        for kind in pii.KINDS:
            n = "".join(rng.choice("23456789") for _ in range(10))
            entity = {"email": f"{sentence(rng, 1)}.{sentence(rng, 1)}@{sentence(rng, 1)}.org", "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
                      "card": "4539578763621486", "phone": f"+44 {n}"}[kind]
            other = pii.respelt(kind, entity, rng)
            left = sentence(rng, 4) + " "
            found = pii.find(f"{left}{other} {sentence(rng, 4)}", weight)[1]
            right += (kind, len(left), len(left) + len(other)) in found
            wrong += (kind, len(left), len(left) + len(other)) not in found
        text = f"{sentence(rng, 4)} {pii._nothing(rng)} {sentence(rng, 4)}"
        base, found = pii.find(text, weight)
        extra += len(found) > len(base)
    assert right / (right + wrong) >= 0.9
    assert extra <= 4


def test_base_spans_stay_and_clean_text_is_left_alone(weight):
    text = f"a {PLAIN['email']} b {PLAIN['ip']}, {PLAIN['card']} and {PLAIN['phone']}."
    base, found = pii.find(text, weight)
    assert base == found == plain(text)
    for clean in ("version 3.1.4 of 2024-01-15", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "CC BY-NC 4.0.", "@media and 12,345,678 rows", "at dot at"):
        assert pii.find(clean, weight) == ([], [])


def test_respelt_beside_base_spans(weight):
    for text in ("see 10.20.30.40 (212) 555-0187 now", "see 10.20.30.40 / 212-555-0187 now", "see (212) 555-0187 10.20.30.40 now"):
        base, found = pii.find(text, weight)
        at = text.index("(212" if "(" in text else "212")
        assert [k for k, _, _ in base] == ["ip"]
        assert ("phone", at, text.index("0187") + 4) in found


def test_gradient_is_that_of_the_likelihood():
    """Against the difference of the log-likelihood, which sums over all segmentations."""
    lattice = pii.Lattice("x 212-555-0187 y")
    truth = {("phone", 2, 14)}
    weight = {"phone: shape": 0.3, "O: digits": -0.2, "phone: bias": 0.1}

    def log_likelihood(w):
        score = [[sum(w.get(f, 0.0) for f in e[2]) for e in edges] for edges in lattice.ending]
        ahead = [0.0]
        for j in range(1, len(lattice.ending)):
            ahead.append(pii._log_sum([ahead[e[0]] + s for e, s in zip(lattice.ending[j], score[j])]))
        inside = [any(s2 <= s < e2 for _, s2, e2 in truth) for s, _ in lattice.tokens]
        gold = sum(s for j in range(1, len(lattice.ending)) for e, s in zip(lattice.ending[j], score[j])
                   if (not inside[e[0]] if not e[1] else (e[1], lattice.tokens[e[0]][0], lattice.tokens[j - 1][1]) in truth))
        return gold - ahead[-1]

    slope = lattice.gradient(weight, truth)
    for f in ("phone: shape", "O: digits", "phone: bias", "card: bias", "O: mark"):
        up, down = {**weight, f: weight.get(f, 0) + 1e-4}, {**weight, f: weight.get(f, 0) - 1e-4}
        assert slope.get(f, 0.0) == pytest.approx((log_likelihood(up) - log_likelihood(down)) / 2e-4, abs=1e-5)


def test_edges(spark, edge, no_documents):
    extra = spark.createDataFrame([(50, f"x {PLAIN['email']} (212) 555-0187 y")], "doc_id long, text string")
    rows = edge.select("doc_id", "text").unionByName(extra)
    found = pii.digest(pii.personal_data(rows)).collect()
    assert len(found) == len(edge_rows()) + 1
    for r in found:
        if r["doc_id"] != 50:
            assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    (one,) = [r for r in found if r["doc_id"] == 50]
    assert one["n_email"] == 1 and one["base_sha256"] == hashlib.sha256(b"email:2:27").hexdigest() and one["spans"].startswith("email:2:27")
    assert pii.personal_data(edge, {}).columns == ["doc_id", "base", "found"]
    assert pii.digest(pii.personal_data(no_documents)).count() == 0

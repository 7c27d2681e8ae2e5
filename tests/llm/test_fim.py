"""Fill-in-middle: against a regular expression and plain slicing, and exact round trips."""
import hashlib
import random
import re

import pytest

from evalspark.llm import fim

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_form(doc_id, text):
    """The contract by slicing code points."""
    text = text or ""
    units = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def made_up(seed):
    r = random.Random(seed)
    parts = [" ", "\n", "\t", "\r\n", "\x0b", "a", "word", "é", "😀", " ", " ", "<P", "P>", "\x00", "<", ">"]
    return "".join(r.choice(parts) for _ in range(r.randrange(0, 60)))


@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_against_slicing(monkeypatch, piece):
    monkeypatch.setattr(fim, "_PIECE", piece)
    forms = set()
    for i in range(400):
        text = made_up(i)
        n, form, p, m, out = fim.transform(text.encode(), i)
        assert (n, form, p, m, bytes(out).decode()) == plain_form(i, text)
        assert bytes(fim.restore(bytes(out), form)).decode() == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_rotate_any_blocks(monkeypatch):
    monkeypatch.setattr(fim, "_PIECE", 2)
    for n in range(8):
        for lo in range(n + 1):
            for mid in range(lo, n + 1):
                for hi in range(mid, n + 1):
                    buf = bytearray(range(n))
                    fim.rotate(buf, lo, mid, hi)
                    assert list(buf) == [*range(lo), *range(mid, hi), *range(lo, mid), *range(hi, n)]


def test_odd_rows(odd_docs, no_docs):
    import pyspark.sql.functions as F
    rows = odd_docs.select("doc_id", "text").collect()
    made = fim.fill_in_middle(odd_docs)
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((i, *plain_form(i, t)) for i, t in rows), key=repr)
    back = fim.restore_texts(made.withColumn("restored", F.lit(1)))
    assert sorted(r["restored"] for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert fim.fim_digests(no_docs).collect() == []
    d = fim.fim_digests(odd_docs).where("doc_id = 5").first()
    assert d["restored_sha256"] == hashlib.sha256(next(t for i, t in rows if i == 5).encode()).hexdigest()


def test_small_batches(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 20) AS text")
    assert {r["doc_id"]: r["output"] for r in fim.fill_in_middle(docs).collect()} == {
        r["doc_id"]: plain_form(r["doc_id"], r["text"])[-1] for r in docs.collect()}

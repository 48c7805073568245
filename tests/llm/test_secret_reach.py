"""Secrets without digits, and base spans far from their words."""

import random

from lectern.llm import secrets


def marked(model, text):
    chains = secrets.chains(text)
    tags = secrets.viterbi(model, [secrets.features(text, c) for c in chains])
    return {text[a:b] for c, t in zip(chains, tags, strict=True) for (a, b), k in zip(c, t, strict=True) if k != 2}


def test_secrets_without_digits_or_near_their_words(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    train = [f"{word(5)} {word(6)} {k} = {word(14)}{d} {word(4)} {word(5)}" for k in ("token", "password", "secret") * 15 for d in ("", "7")]
    train += [f"order 2024-0{i % 9 + 1}-12 {word(6)} number {10_000_000 + i} sent {word(12)}" for i in range(60)]
    model = secrets.train(train)
    assert "correcthorsebatt" in marked(model, "we set pwd = correcthorsebatt and left")
    assert "hunter7" in {t[a:b] for t in ["auth: hunter7"] for c in secrets.chains(t) for a, b in c if secrets.may_begin(t, c)[c.index((a, b))]}
    far = "password" + " " * 500 + "= abcdefgh"
    short = "token:" + " " * 300 + "abcdef"
    rows = spark.createDataFrame([(1, far), (2, short), (3, "pwd = correcthorsebatt"), *((10 + i, t) for i, t in enumerate(train))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(rows)).collect()}
    for k, t in ((1, far), (2, short)):
        assert (got[k]["n_assign"], got[k]["n_access"], got[k]["n_hex"], got[k]["base_sha256"]) == secrets.brute_digest(t) and got[k]["n_assign"] == 1
    assert got[3]["spans"] == "crf:6:22"


def test_chains_cover_tokens_whole_and_in_linear_time():
    text = "auth " + "=" * 20_000 + " " + "x" * 20_000 + " pwd : " + " " * 200 + "y" * 300 + "." * 50_000 + ":" * 20_000
    tokens = {s for c in secrets.chains(text) for s in c}
    assert text.index("y") in {a for a, _ in tokens} and all(text[a:b] != "y" * (b - a) or b - a == 300 for a, b in tokens)

"""Secret scans: base patterns, and a linear-chain conditional random field that tags tokens.

Tokens near something that could be a secret (at least 6 characters of a credential alphabet that hold a digit, or that
stand in or up to 3 tokens behind a key word or an assignment sign) are tagged B, I or O: beginning of, inside, or outside a secret. Features are the token's shape (length, kinds of characters,
entropy), its neighbours (key words, assignment signs, quotes, their shapes) and the file (share of signs, counted over all of it).
All chains of a batch are decoded at once by Viterbi. A token without that shape can only be O or I: this hard
constraint is what lets the rest of a text be skipped, so whole texts are read and no secret by the model is lost.

The field is fitted by maximum likelihood on a bounded sample of rows: up to `max_docs` with spans of the base
patterns (by hash of the key), and as many others that hold digits or signs, of up to `MAX_CHARS` characters each, with up
to `MAX_CHAINS` chains in pieces of `PIECE` tokens; the base spans are the labels. Each is also learned in re-dressed
copies, in which a random credential of another alphabet, length and prefix stands in the secret's place, with other words
or none in front. Key words count as a feature, yet are hidden in half of the training chains, so that shape and
neighbours must carry the decision too.

Spans are `kind:start:end`: code points of the whole match (for `crf`, of the tokens), end exclusive. Model spans that
touch a base span are that span already and are not added. Nulls: a null text is empty. Rows are kept one to one;
repeated keys are fine. Empty table: empty result; without labelled rows the model adds nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.shared import forget, release, with_text

#: Base patterns and least lengths: fixed values of the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")

#: Bounds of the sample that the field is fitted on: texts of each kind, characters of such a text, chains taken of a text
#: and tokens of a piece of a chain. Texts are scanned whole, whatever these bounds are.
MAX_DOCS = 500
MAX_CHARS = 20_000
MAX_CHAINS = 20
PIECE = 60
#: Re-dressed copies of each text with a labelled secret.
COPIES = 2
_COULD = re.compile(r"[A-Za-z0-9+/_=-]*[0-9][A-Za-z0-9+/_=-]*")
_ALPHABET = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*|[^\sA-Za-z0-9+/_=-]")
_KEY = re.compile(r"passw|secret|token|api|key|auth|cred|private|bearer|pwd|access", re.I)
_C = r"[A-Za-z0-9+/_=.-]"
#: A run of the alphabet with a digit, or a key word or sign with the rest of its run.
_SPOT = re.compile(rf"(?<!{_C})(?={_C}{{6}})[A-Za-z+/_=.-]*+[0-9]{_C}*+|(?:{_KEY.pattern}|[=:]){_C}*+", re.I | re.A)
_NEXT = re.compile(rf"(?:\s*+(?:{_C}++|\S)){{0,3}}")
_RUN = re.compile(rf"{_C}*+")
_REACH = 60  # characters on either side of a possible secret that belong to its chain
_B, _I, _O = range(3)
N_FEATURES = 40


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start, then kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Token spans of each stretch of text around possible secrets; no token is cut."""
    near: list[list[int]] = []
    for m in _SPOT.finditer(text):
        a, b = max(0, m.start() - _REACH), max(min(len(text), m.end() + _REACH), _NEXT.match(text, m.end()).end())
        if near and a <= near[-1][1]:
            near[-1][1] = max(near[-1][1], b)
        else:
            near.append([a, b])
    out: list[list[int]] = []
    for a, b in near:
        b = _RUN.match(text, b).end() if b and _RUN.match(text[b - 1]).end() else b
        floor = out[-1][1] if out else 0
        while a > floor and _RUN.match(text[a - 1]).end() and _RUN.match(text[a]).end():
            a -= 1
        if out and a <= floor:
            out[-1][1] = max(b, floor)
        else:
            out.append([a, b])
    return [[m.span() for m in _TOKEN.finditer(text, a, b)] for a, b in out]


def may_begin(text: str, tokens: list[tuple[int, int]]) -> list[bool]:
    """Whether a secret may begin at each token."""
    words = [text[a:b] for a, b in tokens]
    opens = [bool(_KEY.search(w)) or "=" in w or w == ":" for w in words]
    out = []
    for i, w in enumerate(words):
        bare = w.replace(".", "")
        out.append(bool(_ALPHABET.fullmatch(bare)) and (bool(_COULD.fullmatch(bare)) or any(opens[max(0, i - 3) : i + 1])))
    return out


def _coded(text: str) -> bool:
    """Whether more than 2 % of a text's characters are signs of code."""
    return sum(text.count(c) for c in "{}[]();=<>\"'") > 0.02 * max(1, len(text))


def _entropy(token: str) -> float:
    _, n = np.unique(np.frombuffer(token.encode("utf-32-le"), "<u4"), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _shape(token: str) -> list[int]:
    """Numbers of the features that hold for the token itself."""
    digits = sum(c.isdigit() for c in token)
    upper, lower = sum("A" <= c <= "Z" for c in token), sum("a" <= c <= "z" for c in token)
    n = len(token)
    out = [0 if n < 4 else 1 if n < 8 else 2 if n < 12 else 3 if n < 20 else 4 if n < 32 else 5]
    if digits and (upper or lower):
        out.append(6)
    if digits == n:
        out.append(7)
    if digits and not (set(token) - set("0123456789abcdef")):
        out.append(8)
    if digits and upper and not lower:
        out.append(9)
    if upper and lower and digits:
        out.append(10)
    if not digits:
        out.append(11)
    if any(c in "+/=_-" for c in token):
        out.append(12)
    if "." in token:
        out.append(13)
    if n >= 8 and digits:
        e = _entropy(token)
        out.append(14 if e < 2.5 else 15 if e < 3.2 else 16 if e < 3.8 else 17)
    return out


def features(text: str, tokens: list[tuple[int, int]], hide_keys: bool = False, coded: bool | None = None) -> np.ndarray:
    """0/1 features, one row per token."""
    words = [text[a:b] for a, b in tokens]
    shapes = [_shape(w) for w in words]
    key = [not hide_keys and bool(_KEY.search(w)) for w in words]
    sign = [w in ("=", ":") or w.endswith("=") for w in words]
    coded = _coded(text) if coded is None else coded
    x = np.zeros((len(words), N_FEATURES))
    for i in range(len(words)):
        x[i, shapes[i]] = 1
        x[i, 18] = key[i]
        for n, j in enumerate((i - 1, i - 2, i - 3, i + 1)):
            if 0 <= j < len(words):
                x[i, 19 + n] = key[j]
                x[i, 23 + n] = sign[j]
                x[i, 27 + n] = words[j] in ("\"", "'", "`")
                x[i, 31 + n] = 5 in shapes[j] or 4 in shapes[j]
        x[i, 35] = words[i] in ("@",) or (i > 0 and words[i - 1] == "@") or (i + 1 < len(words) and words[i + 1] == "@")
        x[i, 36] = coded
        x[i, 37] = i == 0
    x[:, 38] = may_begin(text, tokens)
    x[:, 39] = 1
    return x


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    x, mask = np.zeros((len(rows), n, N_FEATURES)), np.zeros((len(rows), n), dtype=bool)
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
        mask[i, : len(r)] = True
    return x, mask


#: I can follow B or I only; nothing else is ruled out.
_ALLOWED = np.array([[0.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.0, -1e9, 0.0]])
_START = np.array([0.0, -1e9, 0.0])


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def _emissions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    e = x @ weights
    e[..., _B] -= 1e9 * (x[..., 38] == 0)  # a secret begins at a token of the right shape
    return e


def fit(rows: list[np.ndarray], tags: list[np.ndarray], steps: int = 150, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights and transitions of greatest regularised likelihood, by gradient steps over all chains; chains of like length
    go together, so that padding stays small."""
    held = []
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and len(rows[order[end]]) <= 1.25 * len(rows[order[at]]) + 2:
            end += 1
        x, mask = _padded([rows[i] for i in order[at:end]])
        y = np.full(mask.shape, _O)
        for n, i in enumerate(order[at:end]):
            y[n, : len(tags[i])] = tags[i]
        gold = np.eye(3)[y] * mask[..., None]
        held.append((x, mask, gold, np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])))
        at = end
    n = len(order)
    weights, moves = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    m1, m2 = [0.0, 0.0], [0.0, 0.0]
    for step in range(1, steps + 1):
        parts = [_gradients(*group, weights, moves) for group in held]
        grads = [sum(p[0] for p in parts) / n - l2 * weights, sum(p[1] for p in parts) / n - l2 * moves]
        for i, (param, g) in enumerate(zip((weights, moves), grads, strict=True)):
            m1[i] = 0.9 * m1[i] + 0.1 * g
            m2[i] = 0.999 * m2[i] + 0.001 * g * g
            param += 0.1 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return {"weights": weights, "moves": moves}


def _gradients(x, mask, gold, gold_moves, weights, moves) -> tuple[np.ndarray, np.ndarray]:
    """What the chains' labels have more than the model expects: features by tag, and moves."""
    n, length = mask.shape
    e, t = _emissions(x, weights), moves + _ALLOWED
    alpha, beta = np.zeros((length, n, 3)), np.zeros((length, n, 3))
    alpha[0] = e[:, 0] + _START
    for k in range(1, length):
        nxt = _logsum(alpha[k - 1][:, :, None] + t, 1) + e[:, k]
        alpha[k] = np.where(mask[:, k, None], nxt, alpha[k - 1])
    for k in range(length - 2, -1, -1):
        prev = _logsum(t + (e[:, k + 1] + beta[k + 1])[:, None, :], 2)
        beta[k] = np.where(mask[:, k + 1, None], prev, 0.0)
    z = _logsum(alpha[-1], 1)
    p = np.exp(np.minimum(0, alpha.transpose(1, 0, 2) + beta.transpose(1, 0, 2) - z[:, None, None])) * mask[..., None]
    pair = np.zeros((3, 3))
    for k in range(1, length):
        q = alpha[k - 1][:, :, None] + t + (e[:, k] + beta[k])[:, None, :] - z[:, None, None]
        pair += (np.exp(np.minimum(0, q)) * mask[:, k, None, None]).sum(0)
    return x.reshape(-1, x.shape[2]).T @ (gold - p).reshape(-1, 3), gold_moves - pair


def viterbi(model: dict[str, np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
    """Best tags of every chain; chains of like length are decoded together, so padding stays small."""
    out: list[np.ndarray] = [np.empty(0, int)] * len(rows)
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    t = model["moves"] + _ALLOWED
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < 512 and len(rows[order[end]]) <= 1.5 * len(rows[order[at]]) + 8 and (end - at) * len(rows[order[end]]) < 50_000:
            end += 1
        group = order[at:end]
        at = end
        x, mask = _padded([rows[i] for i in group])
        e = _emissions(x, model["weights"])
        score, back = e[:, 0] + _START, np.zeros(mask.shape + (3,), dtype=np.int8)
        for k in range(1, mask.shape[1]):
            step = score[:, :, None] + t
            back[:, k] = step.argmax(1)
            score = np.where(mask[:, k, None], step.max(1) + e[:, k], score)
        tag = score.argmax(1)
        tags = np.zeros(mask.shape, int)
        rowid = np.arange(len(group))
        for k in range(mask.shape[1] - 1, -1, -1):
            tags[:, k] = tag
            if k:
                tag = np.where(mask[:, k], back[rowid, k, tag], tag)
        for n, i in enumerate(group):
            out[i] = tags[n, : len(rows[i])]
    return out


def _labels(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    tags = np.full(len(tokens), _O)
    for lo, hi in spans:
        own = [i for i, (a, b) in enumerate(tokens) if a < hi and b > lo]
        if own:
            tags[own] = _I
            tags[own[0]] = _B
    return tags


def secret_part(text: str, start: int, end: int, kind: int) -> tuple[int, int]:
    """The credential within a base match: the second group of an assignment, else the match."""
    if kind:
        return start, end
    m = ASSIGN.match(text, start)
    return m.span(2)


def sample(df: DataFrame, text: str, key: str, max_docs: int, max_chars: int = MAX_CHARS) -> list[str]:
    """Up to about `max_docs` texts with base spans and as many others with digits or signs, by hash of the key, each of
    at most `max_chars` characters."""
    body = F.col(text)
    hit = body.rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]") | body.rlike(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    rows = df.select(F.xxhash64(F.col(key).cast("string"), body).alias("h"), body.alias("t"), hit.alias("hit")).filter((F.col("hit") | body.rlike("[0-9=:]")) & (F.length(body) <= max_chars))
    counts = {r["hit"]: r["count"] for r in rows.groupBy("hit").count().collect()}
    part = F.pmod("h", F.lit(1_000_000))
    keep = F.lit(False)
    for h, n in counts.items():
        keep = keep | ((F.col("hit") == h) & (part < int(1_000_000 * min(1.0, max_docs / n))))
    return [r["t"] for r in rows.filter(keep).select("h", "t").orderBy("h").limit(4 * max_docs).collect()]


_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", string.digits + string.ascii_uppercase, string.digits + string.ascii_letters, string.digits + string.ascii_letters + "+/")


def redressed(text: str, span: tuple[int, int, int], rng: random.Random) -> tuple[str, tuple[int, int]]:
    """The surroundings of a base span with another credential in its place, and where that stands.

    Alphabet, length, a short prefix and the words in front vary, so that the credential's own shape has to decide.
    """
    alphabet = rng.choice(_ALPHABETS)
    body = rng.choice("0123456789") + "".join(rng.choice(alphabet) for _ in range(rng.randint(15, 47)))
    prefix = "".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 5))) + rng.choice("_-")
    said = (prefix if rng.random() < 0.4 else "") + body
    name = rng.choice(["auth", "pwd", "key", "access", "private", "credential", "bearer"])
    front, behind = rng.choice([("", ""), ("", ""), (f"{name} = \"", "\""), (f"{name}: ", ""), (f"{name} ", ""), ("(", ")"), (f"{name}='", "'")])
    before = text[max(0, span[0] - 2 * _REACH) : span[0]] + front
    return before + said + behind + text[span[1] : span[1] + 2 * _REACH], (len(before), len(before) + len(said))


def train(texts: list[str], max_chains: int = MAX_CHAINS, piece: int = PIECE, copies: int = COPIES) -> dict[str, np.ndarray] | None:
    rows, tags = [], []

    def learn(text: str, spans: list[tuple[int, int]], hide_keys: bool, coded: bool) -> None:
        pieces = [tokens[at : at + piece] for tokens in chains(text) for at in range(0, len(tokens), piece)]
        told = [(_labels(tokens, spans), tokens) for tokens in pieces]
        told.sort(key=lambda p: not (p[0] != _O).any())  # pieces with labels first, else in order
        for labels, tokens in told[:max_chains]:
            rows.append(features(text, tokens, hide_keys, coded))
            tags.append(labels)

    for n, text in enumerate(texts):
        base, coded, rng = base_spans(text), _coded(text), random.Random(n)
        learn(text, sorted({secret_part(text, *s) for s in base}), bool(n % 2), coded)
        for c in range(copies if base else 0):
            other, span = redressed(text, rng.choice(base), rng)
            learn(other, [span], bool(c % 2), coded)
    if not any((t == _B).any() for t in tags):
        return None
    return fit(rows, tags)


def _spans(texts: list[str], model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int]]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) if t else [] for t in texts]
    added: list[list[tuple[int, int]]] = [[] for _ in texts]
    if model is not None:
        rows, where = [], []
        for i, text in enumerate(texts):
            coded = _coded(text) if text else False
            for tokens in chains(text) if text else ():
                rows.append(features(text, tokens, coded=coded))
                where.append((i, tokens))
        for (i, tokens), tags in zip(where, viterbi(model, rows), strict=True):
            k = 0
            while k < len(tokens):
                if tags[k] != _B:
                    k += 1
                    continue
                end = k + 1
                while end < len(tokens) and tags[end] == _I:
                    end += 1
                lo, hi = tokens[k][0], tokens[end - 1][1]
                if not any(a < hi and b > lo for a, b, _ in base[i]):
                    added[i].append((lo, hi))
                k = end
    return list(zip(base, added, strict=True))


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] | None = None, max_docs: int = MAX_DOCS, mark: str | None = None) -> DataFrame:
    """`keep` (default: the key) and `found`: array of (kind, start, end) in order of start, then kind. A kept column named
    found gives way. With `mark` the text, which has to be kept, has it in place of every found span, and `found` is left out.
    """
    keep = tuple(k for k in keep or (key,) if mark is not None or k != "found")
    model = train(sample(df, text, key, max_docs))
    forget(df.sparkSession)
    told = [] if mark is not None else [T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]
    schema = T.StructType([*(df.schema[k] for k in keep), *told])
    names = (*KINDS, "crf")
    chosen, at_text = with_text(df, keep, text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans_of(batch: pa.RecordBatch) -> list[list[tuple[int, int, int]]]:
        texts = batch.column(at_text).fill_null("")
        # Whatever can be found holds a digit, a sign, a key word, or the letters of an access key or of a hash.
        worth = pc.match_substring_regex(texts, rf"(?i)[0-9=:]|akia|{_KEY.pattern}|[a-f]{{24}}").to_numpy(zero_copy_only=False)
        out: list[list] = [[] for _ in range(len(texts))]
        spots = np.flatnonzero(worth).tolist()
        for at in range(0, len(spots), 256):
            part = spots[at : at + 256]
            for i, (base, added) in zip(part, _spans(texts.take(pa.array(part)).to_pylist(), model), strict=True):
                out[i] = sorted([*base, *((a, b, 3) for a, b in added)], key=lambda s: (s[0], s[2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # In small parts, so that neither side holds the texts of a large batch more than once.
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                out, columns = spans_of(batch), [batch.column(i) for i in range(len(keep))]
                if mark is None:
                    columns.append(pa.array([[{"kind": names[k], "start": a, "end": b} for a, b, k in spans] for spans in out], kind))
                elif any(out):
                    held = [i for i, spans in enumerate(out) if spans]
                    bodies = batch.column(at_text).take(pa.array(held)).to_pylist()
                    clean = pa.array([_replaced(t, out[i], mark) for i, t in zip(held, bodies, strict=True)], batch.column(at_text).type)
                    columns[at_text] = pc.replace_with_mask(batch.column(at_text), pa.array([bool(spans) for spans in out]), clean)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            release()

    return chosen.mapInArrow(run, schema)


def _replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """Spans (in order of start) replaced by `mark`, those that overlap as one."""
    out, at, begun = [], 0, False
    for start, end, _ in spans:
        if start >= at or not begun:
            out += [text[at:start], mark]
        begun, at = True, max(at, end)
    return "".join([*out, text[at:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    def of(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"] != "crf")
    return found.withColumns({**{f"n_{k}": of(k) for k in KINDS}, "base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col("found"))}).drop("found")


def redact(df: DataFrame, text: str = "text", key: str = "doc_id", mark: str = "[secret]", **options) -> DataFrame:
    """The documents with every found span replaced by `mark`; overlapping spans are replaced as one. All columns stay."""
    return scan(df, text, key, tuple(df.columns), mark=mark, **options)


def registered(spark, sf_dir: str) -> DataFrame:
    from lectern.session import table

    return digest(scan(table(spark, sf_dir, "documents")))


def brute_digest(text: str | None) -> tuple[int, int, int, str]:
    """What the base columns must be, for tests."""
    spans = base_spans(text or "")
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)
    return (*(sum(s[2] == k for s in spans) for k in range(3)), hashlib.sha256(said.encode()).hexdigest())

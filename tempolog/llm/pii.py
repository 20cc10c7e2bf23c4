"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give base spans.  The field labels the tokens of every stretch of a text that has digits or
an at-sign, and adds the spans it finds where no base span is.  A token without digit or at-sign can
only be labelled as outside; between two such tokens the chain falls apart, so decoding the stretches one
by one gives the labels of the whole text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))

_EMAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGNS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; a match that fails its check is dropped."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        free = 0
        for m in _EMAIL.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found["email"].append((start, m.end()))
                free = m.end()
    if "." in text:
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


def span_list(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans[k]))


# --- tokens and features ---------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\s]+")


def is_open(token: str) -> bool:
    """Whether a token may be part of a span at all."""
    return bool(_SIGNS.search(token))


def shape(token: str) -> str:
    """Word shape: runs of digits with their length (up to 6), letters as x or X, other signs as they are."""
    out = re.sub(r"[0-9]+", lambda m: "9" * min(6, len(m.group())), token)
    out = re.sub(r"[a-zß-ÿ]+", "x", out)
    return re.sub(r"[A-ZÀ-Þ]+", "X", out)


_NOISY = "#$%&*|!.,;:?\"'"


def token_features(tokens: list[str], k: int) -> list[str]:
    """Features of the k-th token: its shape, parts of it, its digits and its neighbours' shapes."""
    token = tokens[k].rstrip(_NOISY)
    own = shape(token)
    digits = sum(c.isdigit() for c in token)
    before = tokens[k - 1].rstrip(_NOISY) if k else ""
    after = tokens[k + 1].rstrip(_NOISY) if k + 1 < len(tokens) else ""
    return [
        f"s={own}", f"p={own[:3]}", f"q={own[-3:]}", f"n={min(digits, 20)}", f"at={'@' in token}", f"plus={token[:1] == '+'}",
        f"dots={min(token.count('.'), 5)}", f"letters={any(c.isalpha() for c in token)}", f"b={before.lower().strip('.,:;')}" if not is_open(before) else f"bs={shape(before)}",
        f"as={shape(after)}" if is_open(after) else "a", "bias",
    ]


# --- the labelled table ----------------------------------------------------------------------------

#: Sentences with their spans in marks ``<kind|...>``; '#' stands for a digit, '$' for a hex digit, '&' for a
#: capital letter or digit.
EXAMPLES = (
    "call me at <phone|(###) ###-####> today", "phone <phone|###-###-####> or later", "tel: <phone|### ### ####> ext", "fax <phone|(###) ###-####> office",
    "mobile <phone|+# ### ### ####> please", "reach us on <phone|+# (###) ###-####> now", "call <phone|+## ## #### ####> home", "phone <phone|###.###.####> desk",
    "write to <email|ab.##@mail#.example.com> soon", "mail <email|joe@host.org> and", "contact <email|x#@a#.net> there", "send to <email|ann_b#@example.org> please",
    "the server <ip|##.##.###.#> answered", "from <ip|###.##.#.##> at night", "host <ip|#.#.#.#> down", "ping <ip|###.###.##.###> now",
    "card <card|#### #### #### ####> expires", "paid with <card|####-####-####-####> then", "number <card|################> on file", "visa <card|#### ###### #####> ok",
    "under the License, version #.# of", "General Public License, version #.", "in the year #### and", "about ##% of them", "for $## or $##.## each", "chapter ## of book #",
    "released v#.#.# and v#.#.##", "build #.#.#.###-x of", "token = \"$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$$\" in", "password=$$$$$$$$$$$$$$$$$$ the", "key AKIA&&&&&&&&&&&&&&&& is",
    "at ##:## on ##/##/#### we", "from ####-##-## until ####-##-##", "see fig. ## and table #.#", "order ######## shipped", "id ############ of", "sum of ###,### units", "hash $$$$$$$$ seen",
    "follow @name## there", "pages ###-### of", "ratio #.## to #.##", "section #.#.# says", "width ##x## px", "room ### floor ##", "isbn ###-#-##-######-# copy", "by ### ### people", "lines ## ## ## end",
)


#: Each kind as it stands in running text; the table has every pair of kinds side by side, as lists of contacts do.
PLAIN = {"email": ("ab.##@mail#.example.com", "joe#@host.org"), "ip": ("##.###.#.##", "###.##.###.###"), "card": ("################", "#### #### #### ####"), "phone": ("+# (###) ###-####", "(###) ###-####", "+## ### ### ####")}
#: Fillers around such pairs; the signs are what noisy pages put behind words.
AROUND = (("of", "the"), ("on", "and"), ("", ""), ("reach", "or"))
NOISE = ("", "", "", "###", "$$$", "%%%", "&&&", "***", "!!", ".", ",")


def paired_examples() -> list[str]:
    found = []
    for a, b in ((a, b) for a in KINDS for b in KINDS):
        for k, (left, right) in enumerate(AROUND):
            first, second = PLAIN[a][k % len(PLAIN[a])], PLAIN[b][(k // 2) % len(PLAIN[b])]
            found.append(f"{left} <{a}|{first}> <{b}|{second}> {right}")
    triples = (("email", "phone", "card"), ("phone", "card", "ip"), ("card", "ip", "email"), ("ip", "phone", "card"))
    return found + [f"in <{a}|{PLAIN[a][0]}> <{b}|{PLAIN[b][0]}> <{c}|{PLAIN[c][0]}> is" for a, b, c in triples]


def labelled_table(copies: int = 12, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The examples with signs filled in at random, ``copies`` times each: tokens and labels."""
    random = np.random.default_rng(seed)
    fill = {"#": "0123456789", "$": "0123456789abcdef", "&": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"}
    table = []
    for example in (*EXAMPLES, *paired_examples()):
        for _ in range(copies):
            noise = NOISE[random.integers(len(NOISE))]
            tokens, labels = [], []
            for part in re.split(r"(<\w+\|[^>]*>)", example):
                kind, _, body = part[1:-1].partition("|") if part.startswith("<") else ("", "", part)
                for j, token in enumerate(body.split()):
                    money = token.startswith("$#")
                    made = "".join(fill[c][random.integers(len(fill[c]))] if c in fill and not (money and c == "$") else c for c in token)
                    tokens.append(made + noise)
                    labels.append(f"{'I' if j else 'B'}-{kind}" if kind else "O")
            table.append((tokens, labels))
    return table


# --- the field -------------------------------------------------------------------------------------

ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in LABELS] for a in LABELS])
STARTS = np.array([not b.startswith("I-") for b in LABELS])
_NEVER = -1e4


class Field:
    """A trained field: weights of features by label, and of label pairs."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit = index, emit
        self.move = np.where(ALLOWED, move, _NEVER)
        self.start = np.where(STARTS, 0.0, _NEVER)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        """Scores of the labels of each token; tokens that cannot be in a span are outside for certain."""
        out = np.zeros((len(tokens), len(LABELS)))
        for k, token in enumerate(tokens):
            if is_open(token):
                known = [self.index[f] for f in token_features(tokens, k) if f in self.index]
                out[k] = self.emit[known].sum(axis=0)
            else:
                out[k, 1:] = _NEVER
        return out

    def viterbi(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Best label paths of emission matrices, all sequences of a length at a time."""
        paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(sequences)
        by_length: dict[int, list[int]] = {}
        for k, s in enumerate(sequences):
            by_length.setdefault(len(s), []).append(k)
        for length, own in by_length.items():
            if not length:
                continue
            scores = np.stack([sequences[k] for k in own])
            best = scores[:, 0] + self.start
            back = np.zeros((len(own), length, len(LABELS)), np.int64)
            for t in range(1, length):
                through = best[:, :, None] + self.move
                back[:, t] = through.argmax(axis=1)
                best = through.max(axis=1) + scores[:, t]
            at = best.argmax(axis=1)
            path = np.empty((len(own), length), np.int64)
            path[:, -1] = at
            for t in range(length - 1, 0, -1):
                at = back[np.arange(len(own)), t, at]
                path[:, t - 1] = at
            for row, k in zip(path, own, strict=True):
                paths[k] = row
        return paths


def train_field(table: list[tuple[list[str], list[str]]], steps: int = 60, ridge: float = 2e-3) -> Field:
    """Maximum likelihood by gradient ascent with adaptive steps; forward and backward sums in numpy batches."""
    names = sorted({f for tokens, _ in table for k in range(len(tokens)) for f in token_features(tokens, k)})
    index = {f: k for k, f in enumerate(names)}
    label = {b: k for k, b in enumerate(LABELS)}
    emit, move = np.zeros((len(names), len(LABELS))), np.zeros((len(LABELS), len(LABELS)))
    by_length: dict[int, list[tuple[list[list[int]], list[int]]]] = {}
    for tokens, labels in table:
        by_length.setdefault(len(tokens), []).append(([[index[f] for f in token_features(tokens, k)] for k in range(len(tokens))], [label[b] for b in labels]))
    batches = []
    for length, rows in by_length.items():
        wide = max(len(f) for features, _ in rows for f in features)
        features = np.array([[f + [len(names)] * (wide - len(f)) for f in fs] for fs, _ in rows])
        batches.append((length, features, np.array([labels for _, labels in rows])))
    total = len(table)
    speed_emit, speed_move = np.zeros_like(emit), np.zeros_like(move)
    for _ in range(steps):
        grad_emit, grad_move = np.zeros((len(names) + 1, len(LABELS))), np.zeros_like(move)
        padded = np.vstack([emit, np.zeros(len(LABELS))])
        steps_between = np.where(ALLOWED, move, _NEVER)
        for length, features, gold in batches:
            scores = padded[features].sum(axis=2)
            forward = np.empty_like(scores)
            forward[:, 0] = scores[:, 0] + np.where(STARTS, 0.0, _NEVER)
            for t in range(1, length):
                forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps_between, axis=1) + scores[:, t]
            backward = np.zeros_like(scores)
            for t in range(length - 2, -1, -1):
                backward[:, t] = np.logaddexp.reduce(steps_between[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(forward[:, -1], axis=1)
            single = np.exp(forward + backward - z[:, None, None])
            one_hot = np.eye(len(LABELS))[gold]
            np.add.at(grad_emit, features, (one_hot - single)[:, :, None, :])
            for t in range(1, length):
                pair = np.exp(forward[:, t - 1, :, None] + steps_between + (scores[:, t] + backward[:, t])[:, None, :] - z[:, None, None])
                np.add.at(grad_move, (gold[:, t - 1], gold[:, t]), 1)
                grad_move -= pair.sum(axis=0)
        g, h = grad_emit[:-1] / total - ridge * emit, grad_move / total - ridge * move
        speed_emit += g * g
        speed_move += h * h
        emit += 0.5 * g / np.sqrt(speed_emit + 1e-8)
        move += 0.5 * h / np.sqrt(speed_move + 1e-8)
    return Field(index, emit, move)


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_table())


# --- documents -------------------------------------------------------------------------------------


def stretches(text: str) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """Runs of open tokens with two tokens of context on either side: tokens and their places."""
    done = 0
    for m in _SIGNS.finditer(text):
        if m.start() < done:
            continue
        left = m.start()
        for _ in range(3):  # the token itself and two before it
            while left > done and not text[left - 1].isspace():
                left -= 1
            at = left
            while left > done and text[left - 1].isspace():
                left -= 1
            if left == done:
                break
        left = at if left != done else done
        tokens, places, closed = [], [], 0
        seen = False
        for t in _TOKEN.finditer(text, left):
            if not seen and t.end() > m.start():
                seen = True
            open_token = is_open(t.group())
            closed = 0 if open_token else closed + 1
            tokens.append(t.group())
            places.append(t.span())
            if seen and closed == 2:
                break
        done = places[-1][1] if places else m.end()
        yield tokens, places


_OUTER = _NOISY


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without punctuation around it."""
    while start < end and text[start] in _OUTER:
        start += 1
    while end > start and text[end - 1] in _OUTER:
        end -= 1
    return start, end


def field_spans(text: str, runs: list[tuple[list[str], list[tuple[int, int]]]], paths: list[np.ndarray]) -> Iterator[tuple[str, int, int]]:
    for (_, places), path in zip(runs, paths, strict=True):
        current: list | None = None
        for (start, end), k in zip(places, path, strict=True):
            name = LABELS[k]
            if name.startswith("I-") and current:
                current[2] = end
                continue
            if current:
                yield current[0], *trimmed(text, current[1], current[2])
            current = [name[2:], start, end] if name != "O" else None
        if current:
            yield current[0], *trimmed(text, current[1], current[2])


class Taken:
    """Stretches of a text that spans cover: those given, joined where they overlap, and what has been found since.

    What is found comes from left to right, so only its end is remembered.
    """

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends, self.found = [], [], 0
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, start: int, end: int) -> bool:
        """Whether start:end is free; if so, it is taken from now on."""
        k = bisect_left(self.starts, end)
        if start < self.found or k and self.ends[k - 1] > start:
            return False
        self.found = end
        return True


def find_all(texts: list[str], field: Field) -> list[tuple[dict, dict]]:
    """Of each text: base spans, and all spans with those that the field adds."""
    base, runs, scores, owners = [], [], [], []
    for k, text in enumerate(texts):
        if not _SIGNS.search(text):
            base.append({kind: [] for kind in KINDS})
            continue
        base.append(base_spans(text))
        for run in stretches(text):
            runs.append(run)
            scores.append(field.emissions(run[0]))
            owners.append(k)
    every = [{kind: list(s[kind]) for kind in KINDS} for s in base]
    taken: dict[int, Taken] = {}
    for k, run, path in zip(owners, runs, field.viterbi(scores), strict=True):
        if k not in taken:
            taken[k] = Taken(span for kind in KINDS for span in base[k][kind])
        for kind, start, end in field_spans(texts[k], [run], [path]):
            if start < end and taken[k].free(start, end):
                every[k][kind].append((start, end))
    return list(zip(base, every, strict=True))


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    The counts and base_sha256 are of the base spans; spans lists all, as kind:start:end in code points.
    A null text counts as empty and has none; the time that a text takes grows with its length only.  Repeated rows give repeated results, a null doc_id is
    carried, an empty table gives an empty result; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    trained = field or default_field()
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])

    def results(ids: list, texts: list[str]) -> pa.RecordBatch:
        rows = []
        for doc_id, (base, every) in zip(ids, find_all(texts, trained), strict=True):
            added = sum(len(every[k]) - len(base[k]) for k in KINDS)
            rows.append((doc_id, *(len(base[k]) for k in KINDS), hashlib.sha256(span_list(base).encode()).hexdigest(), span_list(every), added))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, load = [], [], 0
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                texts.append(value.as_py())
                load += len(texts[-1])
                if load > 2_000_000:
                    yield results(ids, texts)
                    ids, texts, load = [], [], 0
            if ids:
                yield results(ids, texts)

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")

"""Personal data: pattern matches, and further spans by a semi-Markov conditional random field.

The patterns give the base spans.  The text outside them is cut into tokens, line by line, and the
field chooses segment boundaries and kinds together: every candidate segment of at most MAX_TOKENS tokens is scored by
features of the whole span and by the kind of the segment before, and dynamic programming finds the best segmentation.  A
candidate holds a digit, an @, a long token or a spelled-out "dot", or follows the name of a secret; stretches without any
are plain whatever the weights, and are passed over.  The field, steps between kinds included, is trained here, by
its conditional likelihood, on sentences made up by rule with spans in forms that the patterns miss.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_batches

# The kinds in their order, and the patterns as they are defined.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match from inside a run of digits fails as from its start
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Most tokens of a segment, tokens before it that may cue it, digits of a run too long for any kind, log-odds that an added span needs.
MAX_TOKENS = 14
CUE_TOKENS = 3
MAX_RUN = 96
MARGIN = 2.0

#: What a candidate holds, and the names of secrets that a candidate may follow.
TRIGGER = re.compile(r"[0-9]+|@|[A-Za-z]{20,}|\b(?:dot|DOT|Dot)\b|\b(?i:password|passwd|pwd|passphrase|secret|token|apikey|api[_ ]key)\b(?=[\"']?\s?(?:[:=]|is\b))")
NAME = re.compile(r"password|passwd|pwd|passphrase|secret|token|apikey|api[_ ]key", re.I)
NAMED = re.compile(r"\b(?:password|passwd|pwd|passphrase|secret|token|apikey|api[_ ]key)[\"']?\s?(?:[:=]|is)\s?[\"']?$", re.I)
DIGITS = re.compile(r"[0-9@]")
HOLDS = re.compile(r"[0-9@]|[A-Za-z]{20,}|\b(?:dot|DOT|Dot)\b")
TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
CUES = {
    "email": ("mail", "email", "e-mail", "write", "contact"),
    "ip": ("ip", "host", "server", "address", "node"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "cell"),
    "secret": ("token", "secret", "key", "password", "apikey", "passwd", "pwd", "passphrase", "bearer", "credential"),
}
_CUE = {word: k for k, words in enumerate(CUES.values()) for word in words}

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Pattern matches, leftmost and non-overlapping for each kind; matches that fail their test are dropped."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            found.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            found.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((3, *m.span()))
    return found


FEATURES = 58


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> np.ndarray | None:
    """Features of the span of tokens i to j, ends included; None where no entity can lie."""
    start, end = tokens[i][0], tokens[j][1]
    s = text[start:end]
    if not (s[0].isalnum() or s[0] in "+(") or not (s[-1].isalnum() or s[-1] in "!$%&*=?"):
        return None
    named = NAMED.search(text, max(0, start - 24), start) is not None
    if not (HOLDS.search(s) or (named and " " not in s)):
        return None
    f = np.zeros(FEATURES)
    digits, low, n = _digits(s), s.lower(), j - i + 1
    letters = sum(c.isalpha() for c in s)
    f[0] = 1
    f[1 + sum(len(digits) > x for x in (0, 3, 6, 8, 10, 12, 19))] = 1
    f[9 + sum(n > x for x in (1, 3, 6, 9))] = 1
    f[14], f[15], f[16], f[17] = "@" in s, "." in s, "-" in s, " " in s
    f[18], f[19], f[20] = s[0] == "+", "(" in s and ")" in s, letters == 0
    parts = s.split(".")
    f[21] = len(parts) == 4 and all(p.isdigit() and int(p[-4:]) < 256 for p in parts)
    f[22] = 13 <= len(digits) <= 19 and letters == 0 and luhn(digits)
    f[23] = n == 1 and len(s) >= 20 and letters > 0 and len(digits) > 3
    f[24] = re.search(r"\W(at)\W", low) is not None
    f[25] = re.search(r"\W(dot)\W", low) is not None
    f[26] = bool(re.search(r"(?:\.|\bdot\b\W*)[a-z]{2,6}$", low))
    f[27] = letters > 0 and "@" not in s and not f[23]
    f[28] = bool(re.fullmatch(r"[0-9]{3,4}([-. ][0-9]{3,4}){3,4}", s))
    f[29] = bool(re.fullmatch(r"\(?[0-9]{2,4}\)?[-. ]?[0-9]{3,4}[-. ][0-9]{3,4}", s))
    before, after = text[start - 1 : start], text[end : end + 1]
    f[30] = before.isalnum() or (before != "" and before in ".@-+/")
    f[31] = after.isalnum() or after == "@" or (after == "." and text[end + 1 : end + 2].isalnum())
    for k in (i - 1, i - 2, i - 3):
        if k >= 0 and (cue := _CUE.get(text[slice(*tokens[k])].lower())) is not None:
            f[32 + cue] = 1
            break
    f[37] = bool(re.search(r"[^\w\s.@()+-]", s))
    f[38] = len(s) > 60
    solid = " " not in s
    upper, lower = sum(c.isupper() for c in s), sum(c.islower() for c in s)
    f[39] = named
    f[40] = named and solid and len(s) >= 6
    f[41] = solid and len(s) >= 16 and upper > 2 and lower > 2
    f[42] = solid and len(s) >= 16 and upper > 2 and lower == 0 and letters > 4
    f[43] = solid and len(s) >= 20 and len(digits) == 0 and "@" not in s
    f[44] = bool(re.match(r"(?:sk|pk|rk|ghp|gho|xox[abp]|glpat)[-_]|AKIA|AIza|eyJ", s))
    f[45] = bool(re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", s))
    f[46] = bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", s))
    f[47] = bool(re.fullmatch(r"\w+(?:\W*\bdot\b\W*\w+)*\W*\b(?:at)\b\W*\w+(?:\W*\bdot\b\W*\w+)+", low))
    f[48] = not solid
    f[49] = solid and len(s) >= 16 and len(digits) > 1 and letters > 4
    f[50] = len(set(low)) > 0.5 * len(s) and solid and len(s) >= 16
    f[51] = s[-1] in "!$%&*=?"
    f[52] = not solid and f[47] == 0 and letters > 0
    f[53] = solid and len(s) > 24 and (len(digits) > 4 or (upper > 4 and lower > 4))
    f[54] = bool(re.search(r"[_-]", s)) and letters > 0
    f[55] = before in "\"'=:" and before != ""
    f[56] = letters > 0 and len(digits) == 0 and not f[47]
    f[57] = low in ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "key", "is", "the", "a")
    return f


def ending(text: str, tokens: list[tuple[int, int]], j: int) -> list[tuple[int, np.ndarray]]:
    """The candidate segments that end with token j: (first token, features)."""
    found = ((i, segment_features(text, tokens, i, j)) for i in range(max(0, j - MAX_TOKENS + 1), j + 1))
    return [(i, f) for i, f in found if f is not None]


class Field:
    """Weights: a row of FEATURES for each kind, the cost of a plain token, and the step between kinds."""

    def __init__(self, weights: np.ndarray, step: np.ndarray) -> None:
        self.weights, self.step = weights, step  # (features, kinds), (kinds + 1, kinds + 1)

    def lattice(self, text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, np.ndarray]]]]:
        """Tokens, and for each token the candidate segments ending there: (first token, features)."""
        tokens = [m.span() for m in TOKEN.finditer(text)]
        return tokens, [ending(text, tokens, j) for j in range(len(tokens))]

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[Span]:
        """The best segmentation's entities whose gain over plain tokens is at least MARGIN; ``tokens`` are a run of the text's."""
        n, kinds = len(tokens), len(KINDS)
        score = np.full((n + 1, kinds + 1), -np.inf)
        score[0, kinds] = 0.0
        back = np.zeros((n + 1, kinds + 1), [("from", np.int32), ("kind", np.int8), ("gain", np.float64)])
        for j in range(n):
            options = score[j] + self.step[:, kinds]
            k = int(options.argmax())
            score[j + 1, kinds], back[j + 1, kinds] = options[k], (j, k, 0.0)
            for i, f in ending(text, tokens, j):
                gain = f @ self.weights
                reach = score[i][:, None] + self.step[:, :kinds]
                k = reach.argmax(axis=0)
                for y in range(kinds):
                    total = reach[k[y], y] + gain[y]
                    if total > score[j + 1, y]:
                        score[j + 1, y], back[j + 1, y] = total, (i, int(k[y]), float(gain[y]))
        out, at, y = [], n, int(score[n].argmax())
        while at > 0:
            i, k, gain = back[at, y].item()
            if y < kinds and gain >= MARGIN:
                out.append((y, tokens[i][0], tokens[at - 1][1]))
            at, y = i, k
        return out[::-1]


def _example(rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A made-up sentence and its spans."""
    text, spans = "", []
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(list(letters), rng.integers(2, 9)))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *options: str(options[rng.integers(0, len(options))])
    chars = lambda pool, low, high: "".join(rng.choice(list(pool), rng.integers(low, high)))
    capitals, figures = letters.upper(), "0123456789"

    def card() -> str:
        d = number(15)
        d += next(c for c in figures if luhn(d + c))
        return pick(".", "/", " - ").join(d[k : k + 4] for k in range(0, 16, 4))

    def spelled_out() -> str:
        dot = pick(" dot ", " (dot) ", " [dot] ", " DOT ")
        name = word() + (dot + word() if rng.random() < 0.3 else number(2) if rng.random() < 0.5 else "")
        return name + pick(" at ", " (at) ", " [at] ") + word() + dot + pick("com", "org", "net", "io")

    forms = (
        (spelled_out, spelled_out, lambda: f"{word()}{rng.integers(1, 99)}{pick('@ ', ' @ ')}{word()}.{pick('com', 'org', 'net')}"),
        (lambda: " . ".join(str(x) for x in rng.integers(0, 256, 4)), lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))),
        (card,),
        (lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(4)} {number(3)} {number(4)}", lambda: f"+{number(2)} {number(3)} {number(4)}"),
        (
            lambda: "a1b2" + chars("0123456789abcdef", 24, 44), lambda: chars("0123456789abcdef", 32, 65), lambda: "AKIA" + chars(capitals + figures, 16, 17), lambda: pick("sk-", "pk_live_", "ghp_", "xoxb-", "sk-proj-") + chars(letters + capitals + figures, 20, 44),
            lambda: chars(letters + capitals + figures, 24, 44), lambda: chars(letters + capitals, 32, 44), lambda: f"{number(3)}-{number(2)}-{number(4)}",
            lambda: word() + number(2) + chars("!$%&*", 1, 2) + "#", lambda: chars(letters + capitals + figures, 8, 16) + "#", lambda: word() + word() + "#",
        ),
    )
    plain = (
        lambda: f"{rng.integers(1, 3000)}", lambda: f"{number(2)}.{number(1)}", lambda: f"{rng.integers(1, 32)}-{rng.integers(1, 13)}-{rng.integers(1900, 2030)}", lambda: f"{number(3)},{number(3)}",
        lambda: f"v{number(1)}.{number(1)}.{number(1)}", lambda: f"@{word()}", lambda: f"{number(2)}:{number(2)}", lambda: f"{pick('DE', 'GB', 'FR')}{number(2)} {number(4)} {number(4)} {number(4)} {number(4)} {number(2)}",
        lambda: f"{pick('DE', 'GB', 'FR')}{number(18)}", lambda: chars(letters, 20, 30), lambda: f"{word()} dot {word()}", lambda: f"the {word()} at {word()} {number(2)}", lambda: f"{pick('the password', 'a token', 'secret')} {word()} {word()}",
        lambda: f"{word()}{number(2)}", lambda: f"{capitals[:3]}{number(3)}", lambda: f"{number(5)}-{number(4)}", lambda: f"{word()}-{word()}-{word()}", lambda: f"http {word()}.{word()}", lambda: f"{number(4)}-{number(2)}-{number(2)}T{number(2)}:{number(2)}",
    )
    for _ in range(rng.integers(1, 3)):
        text += " ".join(word() for _ in range(rng.integers(1, 4))) + " "
        kind = int(rng.choice([0, 1, 2, 3, 4, 4, 4, 5, 5, 5]))
        if kind >= len(KINDS):  # what is nothing
            text += plain[rng.integers(0, len(plain))]() + " "
            continue
        if rng.random() < 0.6:
            text += rng.choice(list(CUES[KINDS[kind]])) + str(rng.choice([": ", " ", " = ", ' = "', " no. "]))
        s = forms[kind][rng.integers(0, len(forms[kind]))]()
        if s[-1] == "#":  # a password, which its name must announce
            s = s[:-1]
            text += str(rng.choice(["password", "passwd", "pwd", "Password", "secret"])) + str(rng.choice([": ", " = ", " is ", "="]))
        spans.append((kind, len(text), len(text) + len(s)))
        text += s + str(rng.choice([" ", '" ' if text[-1] == '"' else " ", ". ", ", "]))
    return text + word(), spans


def posteriors(field: Field, n: int, segments: list[tuple[int, int, np.ndarray]], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each candidate as each kind, and expected steps between kinds, by sums forth and back over the lattice."""
    kinds = len(KINDS)
    add = np.logaddexp.reduce
    starting: list[list[int]] = [[] for _ in range(n + 1)]
    ending_: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (i, j, _) in enumerate(segments):
        starting[i].append(k)
        ending_[j + 1].append(k)
    firsts, lasts = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
    ahead, into = np.full((n + 1, kinds + 1), -np.inf), np.empty((n + 1, kinds + 1))
    ahead[0, kinds] = 0.0
    for j in range(n + 1):
        if j:
            ahead[j, kinds] = into[j - 1, kinds]
            if ending_[j]:
                ahead[j, :kinds] = add(into[firsts[ending_[j]], :kinds] + scores[ending_[j]], axis=0)
        into[j] = add(ahead[j][:, None] + field.step, axis=0)
    behind, out = np.zeros((n + 1, kinds + 1)), np.full((n + 1, kinds + 1), -np.inf)
    for i in range(n - 1, -1, -1):
        out[i, kinds] = behind[i + 1, kinds]
        if starting[i]:
            out[i, :kinds] = add(scores[starting[i]] + behind[lasts[starting[i]] + 1, :kinds], axis=0)
        behind[i] = add(field.step + out[i], axis=1)
    total = add(ahead[n])
    share = np.exp(np.minimum(into[firsts, :kinds] + scores + behind[lasts + 1, :kinds] - total, 0.0))
    steps = np.exp(np.minimum(ahead[:n, :, None] + field.step + out[:n, None, :] - total, 0.0)).sum(axis=0)
    return share, steps


@lru_cache(maxsize=1)
def train(examples: int = 700, rounds: int = 4, seed: int = 7) -> Field:
    """Fit the field, steps included, by stochastic gradient ascent of the conditional log-likelihood; reruns agree."""
    rng = np.random.default_rng(seed)
    kinds = len(KINDS)
    field = Field(np.zeros((FEATURES, kinds)), np.zeros((kinds + 1, kinds + 1)))
    field.weights[0] = -2.0
    data = []
    for _ in range(examples):
        text, spans = _example(rng)
        tokens, ends = field.lattice(text)
        gold = {(next((k for k, t in enumerate(tokens) if t[0] == s), -1), next((k for k, t in enumerate(tokens) if t[1] == e), -1)): y for y, s, e in spans}
        segments = [(i, j, f) for j, found in enumerate(ends) for i, f in found]
        truth = np.array([gold.get((i, j), -1) for i, j, _ in segments])
        if not segments or (truth >= 0).sum() < len(spans):
            continue
        steps, last, at = np.zeros((kinds + 1, kinds + 1)), kinds, 0
        begin = {i: (j, y) for (i, j), y in gold.items()}
        while at < len(tokens):
            end, y = begin.get(at, (at, kinds))
            steps[last, y] += 1
            last, at = y, end + 1
        data.append((len(tokens), segments, np.array([s[2] for s in segments]), truth, steps))
    seen = 0
    for _ in range(rounds):
        for k in rng.permutation(len(data)):
            n, segments, matrix, truth, steps = data[k]
            seen += 1
            share, expected = posteriors(field, n, segments, matrix @ field.weights)
            actual = np.zeros_like(share)
            actual[np.flatnonzero(truth >= 0), truth[truth >= 0]] = 1
            rate = 0.3 / (1 + seen / 400)
            field.weights += rate * (matrix.T @ (actual - share)) - rate * 1e-3 * field.weights
            field.step += rate * (0.1 * (steps - expected) - 1e-3 * field.step)
    return field


def _hot(part: str, start: int, end: int, names: bool) -> bool:
    """Whether a candidate may hold this token; a run of digits too long for any kind counts for none."""
    token = part[start:end]
    if HOLDS.search(token) and (end - start <= MAX_RUN or any(len(run) <= MAX_RUN for run in re.findall(r"[0-9]+|@", token))):
        return True
    return names and NAMED.search(part, max(0, start - 24), start) is not None


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """Spans that the field adds outside the base spans; they overlap none of those.

    A line's text between base spans is decoded as a whole.  Tokens that no candidate reaches
    (MAX_TOKENS - 1 away, and the cues before) are left out, which changes no result.
    """
    taken = sorted((s, e) for _, s, e in base)
    out: list[Span] = []
    done, k = 0, 0
    for m in TRIGGER.finditer(text):
        at = m.start()
        while k < len(taken) and taken[k][1] <= at:
            done = max(done, taken[k][1])
            k += 1
        if at < done or (k < len(taken) and taken[k][0] <= at):
            continue
        low = max(done, text.rfind("\n", done, at) + 1)
        high = taken[k][0] if k < len(taken) else len(text)
        line = text.find("\n", at, high)
        high = line if line >= 0 else high
        part = text[low:high]
        tokens = [t.span() for t in TOKEN.finditer(part)]
        names = NAME.search(part) is not None
        runs: list[list[int]] = []
        for t, (s, e) in enumerate(tokens):
            if _hot(part, s, e, names):
                first, end = max(0, t - MAX_TOKENS + 1 - CUE_TOKENS), t + MAX_TOKENS
                if runs and first <= runs[-1][1]:
                    runs[-1][1] = end
                else:
                    runs.append([first, end])
        for first, end in runs:
            out += [(y, low + s, low + e) for y, s, e in field.best(part, tokens[first:end])]
        done = high
    return out


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find personal data in whole texts.

    Returns one row for each input row: ``doc_id``, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``n_spans`` (base and
    added ones), ``n_secret`` (added ones of that kind), ``base`` and ``spans`` (base and added ones): kind:start:end in code points, the end exclusive, by kind and start,
    joined by commas.  A null text is empty and has none.  Ids pass through unread, null or repeated; other columns
    are ignored.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(train())
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, base_text, all_text = [], [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text and DIGITS.search(text) else []
            more = added_spans(text, base, shared.value) if text else []
            counts.append([*(sum(k == kind for k, _, _ in base) for kind in range(4)), len(base) + len(more), sum(k == 4 for k, _, _ in more)])
            base_text.append(spelled(base))
            all_text.append(spelled(base + more))
        columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(6)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, pa.array(base_text, pa.string()), pa.array(all_text, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "n_spans", "n_secret", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs, run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, n_spans long, n_secret long, base string, spans string")



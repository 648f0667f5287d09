r"""Secret scans: fixed patterns, and a character convolutional network over every candidate and its surroundings.

Three patterns are exact and always reported: assignments of at least 6 characters to a secret's name (assign), access key ids
(access) and long hexadecimal runs (hex). Candidates for the network are, of whole texts, every token of LEAST characters that
mixes letters with digits or cases, every password in a connection string, every value given to a further name of a credential,
and every private key block; of one that touches fixed findings, what remains of LEAST characters or more on either side. The characters
of a candidate and those around it, the candidate's own marked, go through a small network in numpy (character embedding,
convolution, maximum and mean pooling, one hidden layer). A long candidate is seen in overlapping windows, all of it, and the greatest
probability counts. A candidate whose calibrated probability reaches the threshold is reported as kind "network".

The network is trained on labelled findings that are generated from a fixed seed: keys, tokens, connection strings and private
keys in code, prose and configuration, against their likes: words, paths, addresses, numbers, version strings, identifiers,
placeholders and text that mentions keys. Probabilities are calibrated by Platt scaling on a held-out third. The threshold is, of
those that still find RECALL of the held-out secrets, the one with the fewest false alarms; where several have them, the lowest.

Spans are in code points, end exclusive, over whole texts; candidates of any length are found.

Edge cases: a null text counts as an empty one, without findings; repeated rows are scanned each; an empty table gives an empty
result; other columns are ignored or, when masking, kept.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Kind, pattern, least length, the group measured.
PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6, 2),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20, 0),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 24, 0),
)
#: Cheap signs that a text may hold an assignment at all.
_NAMES = re.compile(r"(?:passw|secret|token|api_?key)", re.I | re.A)
LEAST = 12
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % LEAST)
_CASES = re.compile(r"[a-z][A-Z].*[a-z][A-Z]", re.S)
_CONNECTION = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@]*:([^\s@/]{3,})@")
_NAMED = re.compile(r"(?:\b(?:pwd|pass|passphrase|credentials?|auth|bearer|signature)|private_?key|access_?key|account_?key|client_?secret)\b[\"']?\s{0,4}[:=]?\s{0,4}[\"']?([^\s\"',;]{8,})", re.I | re.A)
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----\s*(?:[A-Za-z-]+: [^\n]*\n\s*)*[A-Za-z0-9+/=\s]+(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?")
_SIGNS = re.compile(r"pwd|pass|credential|auth|bearer|signature|_?key|client", re.I | re.A)
LEFT, INSIDE, RIGHT = 20, 40, 8
STEP = INSIDE // 2
WIDTH = LEFT + INSIDE + RIGHT
RECALL = 0.95
MASK = "[SECRET]"
_ALPHABET = {c: i + 2 for i, c in enumerate(string.printable)}
_KINDS = len(_ALPHABET) + 2


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index in PATTERNS, end), in order."""
    found = []
    for k, (_, pattern, least, group) in enumerate(PATTERNS):
        if k == 0 and not _NAMES.search(text):
            continue
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


def candidates(text: str, fixed: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Spans that the network judges, in order and apart from each other and from the fixed ones."""
    found = []
    for m in _CANDIDATE.finditer(text):
        t = m.group()
        if any(c.isdigit() for c in t) and any(c.isalpha() for c in t) or _CASES.search(t):
            found.append(m.span())
    if "://" in text:
        found += [m.span(1) for m in _CONNECTION.finditer(text)]
    if _SIGNS.search(text):
        found += [m.span(1) for m in _NAMED.finditer(text) if any(c.isdigit() for c in m.group(1))]
    if "PRIVATE KEY-----" in text:
        found += [m.span() for m in _BLOCK.finditer(text)]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return [x for a, b in out for x in _beside(a, b, fixed)] if fixed else out


def _beside(a: int, b: int, fixed: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What fixed spans, in order, leave of a span: all of it, or parts of LEAST characters or more."""
    parts, at = [], a
    for x, y in fixed:
        if x < b and at < y:
            parts.append((at, x))
            at = y
    return [(a, b)] if not parts else [(x, y) for x, y in [*parts, (at, b)] if y - x >= LEAST]


def windows(text: str, start: int, end: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """Character codes around each part of a candidate, and where the candidate is."""
    for a in range(start, max(end - STEP, start + 1), STEP):
        b = min(a + INSIDE, end)
        left, right = text[max(0, a - LEFT) : a], text[b : b + RIGHT]
        line = left.rjust(LEFT, "\0") + text[a:b].ljust(INSIDE, "\0") + right.ljust(RIGHT, "\0")
        marks = np.zeros(WIDTH)
        marks[LEFT - min(a - start, LEFT) : LEFT + b - a] = 1
        marks[LEFT + INSIDE : LEFT + INSIDE + min(end - b, RIGHT)] = 1
        yield [_ALPHABET.get(c, 0 if c == "\0" else 1) for c in line], marks


class Network:
    """Embedding, convolution of width 5, maximum and mean over the candidate, a hidden layer, a logistic output."""

    SPAN, EMBED, FILTERS, HIDDEN = 5, 12, 24, 16

    def __init__(self, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        shape = {"e": (_KINDS, self.EMBED), "c": ((self.EMBED + 1) * self.SPAN, self.FILTERS), "cb": (self.FILTERS,), "h": (2 * self.FILTERS, self.HIDDEN), "hb": (self.HIDDEN,), "o": (self.HIDDEN,), "ob": (1,)}
        self.p = {k: r.standard_normal(s) * (0.0 if k.endswith("b") else 1 / np.sqrt(s[0]) if k != "e" else 0.3) for k, s in shape.items()}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, codes: np.ndarray, marks: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(codes)
        x = np.concatenate([p["e"][codes], marks[:, :, None]], 2)
        strips = np.lib.stride_tricks.sliding_window_view(x, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, WIDTH - self.SPAN + 1, -1)
        z = strips @ p["c"] + p["cb"]
        a = np.maximum(z, 0)
        top = a.argmax(1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)], 1)
        hz = pooled @ p["h"] + p["hb"]
        h = np.maximum(hz, 0)
        return {"strips": strips, "z": z, "top": top, "pooled": pooled, "hz": hz, "h": h, "logit": h @ p["o"] + p["ob"]}

    def gradients(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f, n = self.p, self.forward(codes, marks), len(y)
        d = (1 / (1 + np.exp(-f["logit"])) - y) / n
        g = {"o": f["h"].T @ d, "ob": d.sum(keepdims=True)}
        dh = np.outer(d, p["o"]) * (f["hz"] > 0)
        g["h"], g["hb"] = f["pooled"].T @ dh, dh.sum(0)
        dp = dh @ p["h"].T
        steps = f["z"].shape[1]
        da = np.repeat(dp[:, None, self.FILTERS :] / steps, steps, 1)
        np.put_along_axis(da, f["top"][:, None], np.take_along_axis(da, f["top"][:, None], 1) + dp[:, None, : self.FILTERS], 1)
        dz = da * (f["z"] > 0)
        flat = dz.reshape(-1, self.FILTERS)
        g["c"], g["cb"] = f["strips"].reshape(len(flat), -1).T @ flat, flat.sum(0)
        dx = (flat @ p["c"].T).reshape(n, steps, self.SPAN, self.EMBED + 1)[..., : self.EMBED]
        g["e"] = np.zeros_like(p["e"])
        for k in range(self.SPAN):
            np.add.at(g["e"], codes[:, k : k + steps].ravel(), dx[:, :, k].reshape(-1, self.EMBED))
        return g

    def fit(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01) -> None:
        r = np.random.default_rng(3)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(y), 64):
                b, t = order[i : i + 64], t + 1
                for k, g in self.gradients(codes[b], marks[b], y[b]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, codes: np.ndarray, marks: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, then the threshold."""
        logit = self.forward(codes, marks)["logit"]
        for _ in range(500):
            d = 1 / (1 + np.exp(-(self.slope * logit + self.shift))) - y
            self.slope -= 0.05 * float((d * logit).mean())
            self.shift -= 0.05 * float(d.mean())
        self.threshold = self.choose(self.probability(codes, marks), y)

    @staticmethod
    def choose(chance: np.ndarray, y: np.ndarray) -> float:
        """Of the thresholds that keep RECALL, that with the fewest false alarms; of these the lowest, halfway to the next probability below."""
        good, bad = np.sort(chance[y == 1]), np.sort(chance[y == 0])
        most = good[int((1 - RECALL) * len(good))]  # the highest that keeps RECALL
        alarms = len(bad) - np.searchsorted(bad, most)
        under = float(bad[len(bad) - alarms - 1]) if alarms < len(bad) else 0.0
        lowest = float(good[np.searchsorted(good, under, "right")])
        return (lowest + under) / 2

    def probability(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.forward(codes, marks)["logit"] + self.shift)))


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) from a fixed seed, half of them secrets."""
    r = random.Random(seed)
    pick = lambda chars, a, b: "".join(r.choices(chars, k=r.randint(a, b)))
    common = ("th", "er", "on", "an", "re", "tion", "le", "ment", "que", "ung", "los", "ar", "in", "be", "st")
    begins = "b c d f g h j k l m n p qu r s t v w z bl br ch cl cr dr fl fr gl gr kn ph pl pr sch sh sk sl sm sn sp st str sw th tr tw wh ll gw".split()
    middles, ends = "a e i o u y ae ai au ea ee ei ie io oa oo ou ue".split(), ["", "", "", *"b c ck ct d f g l ll ld lt m mp n nd ng nt p r rd rn rt s ss st t th x z rch".split()]
    syllable = lambda: r.choice(common) if r.random() < 0.4 else r.choice(begins) + r.choice(middles) + r.choice(ends)
    word = lambda: "".join(syllable() for _ in range(r.randint(1, 4)))
    number = lambda a=1, b=4: pick(string.digits, a, b)
    ending = lambda: r.choice(("py", "html", "txt", "so", "jpg", "png", "json", "tar.gz", "js", "css", "md", "pdf", "cpp", "xml"))
    domain = lambda: f"{r.choice((word(), 'mail' + number(1, 1), 'www', word() + number(1, 2)))}.{r.choice((word(), 'example'))}.{r.choice(('com', 'org', 'net', 'de', 'co.uk', 'edu'))}"
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    letters, both = string.ascii_letters, string.ascii_letters + digits
    scheme = lambda: r.choice(("postgres", "postgresql", "mysql", "amqp", "ftp", "https", "mongodb", "smtp"))
    host = lambda: r.choice(("localhost", "127.0.0.1", f"{word()}.{word()}.com", f"db.{word()}.internal")) + r.choice(("", ":5432", ":3306", f"/{word()}"))
    strong = lambda: "".join(r.sample(pick(lower, 3, 8) + pick(upper, 1, 4) + pick(digits, 1, 4) + pick("!#$%&*^", 0, 2), k=1)) + pick(both + "!#$%^&*", 7, 16)
    key = lambda: r.choice(("", "RSA ", "EC ", "OPENSSH "))
    lead = lambda: r.choice((" ", ": ", ' = "', "=", " key ", " auth: Bearer ", "\n"))
    plain_lead = lambda: r.choice((" ", " ", "\n", " see ", ": ", ' = "', " ("))
    tail = lambda: r.choice((" ", '"', "\n", ".", ", ")) + word()

    def block() -> tuple[str, str, str]:
        kind, lines = key(), "\n".join(pick(both + "+/", 64, 64) for _ in range(r.randint(1, 6)))
        return "\n", f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n{pick(both + '+/', 10, 40)}=\n" + f"-----END {kind}PRIVATE KEY-----" * (r.random() < 0.9), "\n"

    #: Each gives what stands before, the value, what stands behind.
    secret = (
        lambda: (lead(), pick(both, 20, 48), tail()), lambda: (lead(), pick(both + "+/", 24, 88) + r.choice(("", "=", "==")), tail()),
        lambda: (lead(), r.choice(("ghp_", "gho_", "sk-", "glpat-", "sk_live_", "AIza", "npm_", "pypi-", "rk_test_", "shpat_")) + pick(both, 20, 40), tail()),
        lambda: (lead(), f"{pick(lower, 2, 4)}{r.choice('-_')}{pick(digits, 8, 12)}-{pick(digits, 8, 12)}-{pick(both, 16, 32)}", tail()),
        lambda: (lead(), f"{pick(upper, 2, 3)}.{pick(both + '-_', 18, 24)}.{pick(both + '-_', 36, 44)}", tail()),
        lambda: (lead(), f"eyJ{pick(both, 16, 30)}.eyJ{pick(both, 20, 120)}.{pick(both + '-_', 20, 43)}", tail()),
        lambda: (lead(), pick(digits + "abcdef", 24, 64), tail()), lambda: (lead(), "AKIA" + pick(upper + digits, 16, 16), tail()),
        lambda: (lead(), pick(both + "-_", 32, 44), tail()), lambda: (lead(), pick(upper + digits, 24, 40), tail()),
        lambda: (f" {scheme()}://{r.choice((word(), 'admin', 'root', 'user', ''))}:", strong(), f"@{host()} "),
        lambda: (f" {scheme()}://{r.choice((word(), 'admin', 'root', 'svc', 'app'))}:", pick(both, 8, 30), f"@{host()} "),
        lambda: (r.choice((" pwd: ", " pwd=", " passphrase: ", ' private_key = "', " AccountKey=", " client_secret: ", ' access_key: "', " Authorization: Bearer ")), strong() + pick(both, 0, 20), tail()),
        block,
    )
    plain = (
        lambda: (plain_lead(), "/".join(word() for _ in range(r.randint(4, 8))) + f"/{r.randint(1, 999)}", tail()), lambda: (plain_lead(), f"{word()}-{word()}-{word()}-{r.randint(1, 99999)}", tail()),
        lambda: (plain_lead(), ".".join((word(), word(), "example", "com", str(r.randint(1, 99)))), tail()),
        lambda: (plain_lead(), f"{r.randint(2000, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}-{r.randint(0, 59):02}", tail()),
        lambda: (plain_lead(), "_".join(word() for _ in range(r.randint(3, 6))) + str(r.randint(0, 9)), tail()), lambda: (plain_lead(), f"{word()}.{word()}.{word()}.{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", tail()),
        lambda: (plain_lead(), "".join(word().title() for _ in range(r.randint(4, 7))), tail()), lambda: (plain_lead(), word() * r.randint(4, 7) + str(r.randint(1, 9)), tail()),
        lambda: (plain_lead(), f"www.{word()}{word()}.org/{word()}/{r.randint(1, 9999)}.html", tail()), lambda: (plain_lead(), "=" * r.randint(14, 30) + str(r.randint(1, 9)) + word(), tail()),
        lambda: (plain_lead(), "_".join(word().upper() for _ in range(r.randint(3, 5))) + f"_{r.randint(1, 99)}", tail()), lambda: (plain_lead(), f"{word()}{word()}.{word()}({word()})".split("(")[0] + f".{word().title()}{r.randint(1, 9)}", tail()),
        lambda: (plain_lead(), "".join(r.choice(("ab", "xy", "1", "2", "-")) for _ in range(3)) + "-".join(pick(digits, 2, 5) for _ in range(4)) + "x", tail()),
        lambda: (" http://", f"{word()}.{word()}.org/{'/'.join(word() for _ in range(r.randint(2, 9)))}-{r.randint(1, 99)}/", tail()), lambda: (plain_lead(), "-".join(word() for _ in range(r.randint(3, 12))) + str(r.randint(1, 999)), tail()),
        lambda: (f" {scheme()}://{r.choice(('user', 'username', word()))}:", r.choice(("password", "passwd", "pass", "<password>", "${DB_PASSWORD}", "$PASSWORD", "xxxxxxxx", "********", "PASSWORD", "{password}", "your_password", "%s")), f"@{host()} "),
        lambda: (r.choice((" pwd: ", " passphrase: ", ' private_key = "', " client_secret: ", " auth=", " signature: ")), r.choice((f"{word()}_{word()}_{r.randint(1, 9)}", f"os.environ['{word().upper()}_1']", f"<{word()}-{word()}-1>", f"${{{word().upper()}_{word().upper()}_2}}", f"{word()}{word()}{word()}1", f"/etc/{word()}/{word()}.pem1")), tail()),
        lambda: (f" {word()}.{number(2, 2)}@", domain(), r.choice((" ", ".", ", ", "\n")) + word()), lambda: (plain_lead(), f"{word()}{word()}.{number(2, 4)}", f"@{domain()} "), lambda: (plain_lead(), f"{word()}.{word()}{number(1, 3)}", f"@{domain()}, "),
        lambda: (" ", f"/{r.choice(('usr', 'home', 'etc', 'var', 'opt'))}/{'/'.join(word() + r.choice(('', number(1, 2), '.' + number(1, 2), '-' + word())) for _ in range(r.randint(1, 6)))}/_{word()}.{ending()}", tail()),
        lambda: (plain_lead(), f"{'/'.join(word() for _ in range(r.randint(1, 5)))}/{word()}_{word()}{number()}.{ending()}", tail()), lambda: (plain_lead(), "-".join(pick(digits + "abcdef", n, n) for n in (8, 4, 4, 4, 12)), tail()),
        lambda: (plain_lead(), f"{number(1, 2)}.{number(1, 2)}.{number(1, 2)}{r.choice(('-alpha', '-beta', '-rc', '+build', '.dev', '-SNAPSHOT'))}.{number(1, 2)}{r.choice(('', '+build.' + number(6, 8), '+' + word()))}", tail()),
        lambda: (plain_lead(), ".".join(word() for _ in range(r.randint(2, 5))) + "." + "".join(word().title() for _ in range(r.randint(1, 3))) + number(1, 1), tail()), lambda: (" https://", f"{domain()}/{'/'.join(r.choice((word(), word() + '-' + word(), number(), word()[:1])) for _ in range(r.randint(1, 6)))}/{word()}.{ending()}", tail()),
        lambda: (plain_lead(), word() + word() + word() + number(), tail()), lambda: (plain_lead(), "".join(word() for _ in range(r.randint(4, 9))) + number(1, 2), tail()), lambda: (plain_lead(), f"{r.choice(('IMG', 'DSC', word(), 'report'))}{r.choice('_-')}20{number(2, 2)}{r.choice(('', '-'))}{number(2, 2)}{r.choice(('', '-'))}{number(2, 2)}{r.choice('_-')}{r.choice((number(6, 6), word()))}.{ending()}", tail()),
        lambda: (plain_lead(), f"{word()}.{word().title()}. {word()}".split()[0] + f".{number(1, 2)}", tail()), lambda: (" ", f"{word()}.{word().title()}.{word()}.{number(2, 2)}", f"@{domain()} "), lambda: (plain_lead(), f"{number()}mg/kg-{number()}mg/l", tail()), lambda: (plain_lead(), f"{word()}{''.join(word().title() for _ in range(r.randint(1, 5)))}{number(0, 2)}", tail()),
        lambda: ("\n", f"-----BEGIN {key()}PRIVATE KEY-----\n{r.choice(('', 'your ', 'paste '))}{' '.join(word() for _ in range(r.randint(1, 6)))} ", "\n"),
    )
    out = []
    for i in range(n):
        label = i % 2
        left, value, right = r.choice(secret if label else plain)()
        before = " ".join(word() for _ in range(r.randint(0, 5))) + left
        out.append((before + value + right, len(before), len(before) + len(value), label))
    return out


def examples(rows: list[tuple[str, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, marks and labels of all windows of labelled findings."""
    seen = [(*w, label) for text, a, b, label in rows for w in windows(text, a, b)]
    return np.array([c for c, _, _ in seen]), np.array([m for _, m, _ in seen]), np.array([y for _, _, y in seen], float)


_TRAINED: list[Network] = []


def trained(n: int = 9600) -> Network:
    """The network, fitted once in a process."""
    if not _TRAINED:
        rows = labelled_findings(n, 17)
        cut = 2 * n // 3
        net = Network()
        net.fit(*examples(rows[:cut]))
        net.calibrate(*examples(rows[cut:]))
        _TRAINED.append(net)
    return _TRAINED[0]


def chances(spans: list[tuple[str, int, int]], net: Network, batch: int = 512) -> list[float]:
    """For each (text, start, end) the greatest probability of its windows; at most batch windows are held at a time."""
    best = [0.0] * len(spans)
    held: list[tuple[int, list[int], np.ndarray]] = []

    def judge() -> None:
        for (i, _, _), p in zip(held, net.probability(np.array([c for _, c, _ in held]), np.array([m for _, _, m in held])).tolist(), strict=True):
            best[i] = max(best[i], p)
        held.clear()

    for i, (text, a, b) in enumerate(spans):
        for codes, marks in windows(text, a, b):
            held.append((i, codes, marks))
            if len(held) >= batch:
                judge()
    if held:
        judge()
    return best


def scan_texts(texts: list[str], net: Network) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]]:
    """For each text its fixed spans, all spans (kind len(PATTERNS): network), and the least probability of a fixed one (1: none)."""
    fixed = [base_spans(t) for t in texts]
    jobs = []
    for i, text in enumerate(texts):
        jobs += [(i, True, a, b) for a, _, b in fixed[i]]
        jobs += [(i, False, a, b) for a, b in candidates(text, [(a, b) for a, _, b in fixed[i]])]
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least = [1.0] * len(texts)
    for (i, known, a, b), chance in zip(jobs, chances([(texts[i], a, b) for i, _, a, b in jobs], net), strict=True):
        if known:
            least[i] = min(least[i], chance)
        elif chance >= net.threshold:
            extra[i].append((a, len(PATTERNS), b))
    return [(f, sorted(f + e), p) for f, e, p in zip(fixed, extra, least, strict=True)]


def show(spans: list[tuple[int, int, int]]) -> str:
    names = [*(p[0] for p in PATTERNS), "network"]
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, base_probability for each row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = scan_texts([t or "" for t in batch.column(1).to_pylist()], shared.value)
            counts = [pa.array([sum(k == kind for _, k, _ in f) for f, _, _ in found], pa.int64()) for kind in range(len(PATTERNS))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *counts, pa.array([hashlib.sha256(show(f).encode()).hexdigest() for f, _, _ in found], pa.string()),
                pa.array([show(s) for _, s, _ in found], pa.string()), pa.array([p for _, _, p in found], pa.float64()),
            ], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "base_probability"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, base_probability double")


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of its text replaced by MASK; nulls stay null and other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = scan_texts([t or "" for t in texts], shared.value)
            new = pa.array([t if t is None else mask(t, s) for t, (_, s, _) in zip(texts, found, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

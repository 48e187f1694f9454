"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

Globs are packed into multiword Shift-And masks (64-bit words): a bit per position of every glob, so that one step over
a byte moves all globs at once. A whole batch of URLs is stepped together in numpy, byte by byte; URLs whose states are
all gone, or that have ended, leave the batch.

The canonical URL is host + path: the host is what stands after the first "://" up to "/", "?", "#" or the end, A-Z in
lower case; the path goes on up to "?", "#" or the end. In globs, "*" is any run without "/", "**" any run, "?" one
character other than "/", and a backslash takes the next character literally.

Rules (action, host, path) fit the host and its subdomains where the path starts with the rule's; each becomes two
globs. The longest rule that fits decides (equal lengths: block, then the first); where none fits, the method's own
block globs decide, and what these leave is allowed. A null URL, or one without "://", has an empty host and path,
which no rule fits. Very long URLs are stepped like others. Repeated rows are judged alike; unknown columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ALLOW, BLOCK = "allow", "block"
RULES = ((BLOCK, "net", "/"), (ALLOW, "example.net", "/en/"), (BLOCK, "example.com", "/de/"), (ALLOW, "org", "/fr/"))
#: Blocked where no rule fits.
GLOBS = ("ads.*/**", "*.ads.*/**", "tracker.*/**", "*.tracker.*/**", "*/**.exe", "*/**.zip", "*/wp-login**", "*/**/wp-login**", "*/cgi-bin/**", "*/**/cgi-bin/**")
_ONE = np.uint64(1)


def literal(text: str) -> str:
    return "".join("\\" + c if c in "*?\\" else c for c in text)


def rule_globs(host: str, path: str) -> list[str]:
    return [f"{literal(host)}{literal(path)}**", f"*.{literal(host)}{literal(path)}**"]


def canonical(url: str | None) -> tuple[str, str]:
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def parsed(glob: str) -> tuple[list, dict[int, str]]:
    """(characters: bytes, or None for "?"), and which positions loop: "*" or "**" after so many characters."""
    chars: list = []
    loops: dict[int, str] = {}
    data, i = glob.encode("utf-8"), 0
    while i < len(data):
        if data[i : i + 2] == b"**":
            loops[len(chars)] = "**"
            i += 2
        elif data[i : i + 1] == b"*":
            loops.setdefault(len(chars), "*")
            i += 1
        elif data[i : i + 1] == b"?":
            chars.append(None)
            i += 1
        else:
            i += data[i : i + 1] == b"\\" and i + 1 < len(data)
            chars.append(data[i])
            i += 1
    return chars, loops


@dataclass
class Automaton:
    words: int
    start: np.ndarray  # (words)
    step: np.ndarray  # (256, words): positions that this byte enters
    stay: np.ndarray  # (256, words): positions that this byte keeps
    final: np.ndarray  # (globs): bit number of each glob's last position

    @classmethod
    def of(cls, globs: list[str]) -> Automaton:
        bits = sum(len(parsed(g)[0]) + 1 for g in globs)
        words = max(1, -(-bits // 64))
        start, step, stay = np.zeros(words, np.uint64), np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        final, at = [], 0

        def put(table, rows, bit):
            table[rows, bit // 64] |= _ONE << np.uint64(bit % 64)

        every = np.arange(256)
        no_slash, going_on = every[every != 47], every[(every >= 0x80) & (every < 0xC0)]
        for g in globs:
            chars, loops = parsed(g)
            start[at // 64] |= _ONE << np.uint64(at % 64)
            for k, c in enumerate(chars, 1):
                if c is None:  # one code point: a first byte enters, the bytes that go on with it stay
                    put(step, no_slash[(no_slash < 0x80) | (no_slash >= 0xC0)], at + k)
                    put(stay, going_on, at + k)
                else:
                    put(step, c, at + k)
            for k, kind in loops.items():
                put(stay, every if kind == "**" else no_slash, at + k)
            at += len(chars) + 1
            final.append(at - 1)
        return cls(words, start, step, stay, np.array(final, np.int64))

    def match(self, urls: list[bytes]) -> np.ndarray:
        """(urls, globs) booleans."""
        n = len(urls)
        sizes = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        at = (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        states, out = np.tile(self.start, (n, 1)), np.zeros((n, self.words), np.uint64)
        who, j = order, 0
        while len(who):
            going = np.searchsorted(-left, -j, "left") if len(left) else 0  # those longer than j come first
            if going < len(who):
                out[who[going:]] = states[going:]
                who, at, left, states = who[:going], at[:going], left[:going], states[:going]
                if not len(who):
                    break
            byte = flat[at + j]
            moved = states << _ONE
            if self.words > 1:
                moved[:, 1:] |= states[:, :-1] >> np.uint64(63)
            states = (moved & self.step[byte]) | (states & self.stay[byte])
            j += 1
            if j % 16 == 0 and not (alive := states.any(1)).all():
                who, at, left, states = who[alive], at[alive], left[alive], states[alive]
        return (out[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & _ONE != 0


SCHEMA = "page_id long, host string, path string, rule string, verdict string, glob string"


def _task(rules: tuple, globs: tuple):
    patterns = [g for _, host, path in rules for g in rule_globs(host, path)]
    automaton = Automaton.of([*patterns, *globs])
    # the longest rule first; equal lengths: block before allow, then in order
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][0] != BLOCK, i))
    names = [r[1] + r[2] for r in rules]
    schema = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("host", "path", "rule", "verdict", "glob"))])

    def task(batches):
        for batch in batches:
            split = [canonical(u) for u in batch.column(1).to_pylist()]
            hits = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in split])
            by_rule = hits[:, : 2 * len(rules)].reshape(len(split), len(rules), 2).any(2)[:, rank] if rules else np.zeros((len(split), 0), bool)
            own = hits[:, 2 * len(rules) :]
            rule, verdict, glob = [], [], []
            for i in range(len(split)):
                r = rank[by_rule[i].argmax()] if by_rule[i].any() else None
                g = globs[own[i].argmax()] if own[i].any() else None
                rule.append(None if r is None else names[r])
                glob.append(g)
                verdict.append(rules[r][0] if r is not None else BLOCK if g else ALLOW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((batch.column(0), [h for h, _ in split], [p for _, p in split], rule, verdict, glob), schema, strict=True)], schema=schema)

    return task


def filter_urls(pages: DataFrame, rules: tuple = RULES, globs: tuple = GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and glob of every row. Only the two columns are read, and nothing is shuffled."""
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url")).mapInArrow(_task(rules, globs), SCHEMA)

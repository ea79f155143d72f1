"""URL filters by a bit-parallel wildcard automaton.

A URL's canonical form is a full stop, its host with A-Z lower-cased, the byte HOST_END, and its path; scheme, query and
fragment aren't in it. All glob rules are packed, one after another, into a vector of 64-bit words: a bit for each rule's
start and one for each of its characters. Reading a byte shifts all bits by one, keeps those whose character it is, and
keeps the bits before a star where they are (Shift-And with self-loops); a star on the host's side of a rule with HOST_END
doesn't read that byte, so it ends with the host. The URLs of a batch are simulated together, longest first, one byte column
at a time, so each step is a few operations on a (URLs x words) array whatever the number of rules. What only a few
very long URLs have left is read with the same masks as one integer for each URL.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Between host and path in the automaton's text; no UTF-8 text has this byte.
HOST_END = b"\xff"
#: (verdict, host, path) of rules that name a host and where its paths start; the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Globs over ".host" and path, side by side, that block where no such rule fits: fixed values, by what they name.
BLOCK_GLOBS = (
    # advertising and tracking hosts
    "*.ads.*", "*.adserver.*", "*.doubleclick.*", "*.googlesyndication.*", "*.googleadservices.*", "*.adnxs.*", "*.taboola.*", "*.outbrain.*", "*.criteo.*", "*.tracking.*", "*.analytics.*",
    # advertising in paths
    "*/ads/*", "*/adclick*", "*/banner*", "*/sponsored/*", "*/affiliate*",
    # what the words name
    "*spam*", "*adult*", "*casino*", "*porn*", "*xxx*", "*poker*", "*viagra*", "*escort*", "*jackpot*", "*payday-loan*",
    # pages of an account, a shop or a search
    "*/login*", "*/signin*", "*/logout*", "*/register*", "*/password-reset*", "*/cart*", "*/checkout*", "*/wishlist*", "*/search/*", "*/wp-admin/*", "*/wp-login*", "*/cgi-bin/*",
    # lists of other pages, and what isn't text
    "*/tag/*/page/*", "*/category/*/page/*", "*/calendar/20??-??*", "*/feed/", "*.jpg", "*.png", "*.gif", "*.mp4", "*.zip", "*.exe",
)
URLS_AT_ONCE = 2048
#: As few URLs or fewer are read on as integers.
FEW = 8


@dataclass
class Automaton:
    """Masks of the packed rules; each array has a row of 64-bit words."""

    reads: np.ndarray  # (256, words): where a byte may lead to
    stays: np.ndarray  # (256, words): where a byte may leave the state
    starts: np.ndarray
    ends: list[tuple[int, np.uint64]]

    @classmethod
    def of(cls, globs: Sequence[str | bytes]) -> Automaton:
        """'*' stands for any bytes, '?' for one; all else for itself. Before HOST_END in a rule neither reads that byte."""
        bits, ends = 0, []
        reads, stays, starts = [], [], []
        for glob in globs:
            glob = glob if isinstance(glob, bytes) else glob.encode()
            edge = glob.find(HOST_END)
            starts.append(bits)
            for at, c in enumerate(glob):
                any_byte = slice(0, 255 if at < edge else 256)
                if c == ord("*"):
                    stays.append((any_byte, bits))
                else:
                    bits += 1
                    reads.append((any_byte if c == ord("?") else c, bits))
            ends.append(bits)
            bits += 1
        words = -(-max(bits, 1) // 64)

        def table(entries: Iterable[tuple[slice | int, int]], rows: int = 256) -> np.ndarray:
            out = np.zeros((rows, words), np.uint64)
            for c, b in entries:
                out[c, b // 64] |= np.uint64(1 << b % 64)
            return out

        return cls(table(reads), table(stays), table(((0, b) for b in starts), 1)[0], [(b // 64, np.uint64(1 << b % 64)) for b in ends])

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """(texts, rules): whether the rule matches the whole text."""
        out = np.zeros((len(texts), len(self.ends)), bool)
        if not len(texts) or not self.ends:
            return out
        lengths = np.array([len(t) for t in texts])
        order = np.argsort(-lengths, kind="stable")  # those that are still read come first
        lengths = lengths[order]
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        state = np.repeat(self.starts[None], len(texts), 0)
        for at in range(lengths[0]):
            n = int(np.searchsorted(-lengths, -at, "left"))  # longer than at
            if n <= FEW and lengths[0] - at > 64:
                for k in range(n):
                    state[k] = self._read_on(state[k], texts[order[k]][at:])
                break
            now, byte = state[:n], data[begins[:n] + at]
            carry = now >> np.uint64(63)
            moved = now << np.uint64(1)
            moved[:, 1:] |= carry[:, :-1]
            state[:n] = (moved & self.reads[byte]) | (now & self.stays[byte])
        for k, (word, bit) in enumerate(self.ends):
            out[order, k] = (state[:, word] & bit) > 0
        return out

    def _read_on(self, state: np.ndarray, text: bytes) -> np.ndarray:
        """The state after text, with all words as one integer."""
        whole = lambda row: int.from_bytes(row.astype("<u8").tobytes(), "little")
        reads, stays, now = [whole(r) for r in self.reads], [whole(r) for r in self.stays], whole(state)
        for c in text:
            now = now << 1 & reads[c] | now & stays[c]
        return np.frombuffer(now.to_bytes(8 * len(state), "little"), "<u8").astype(np.uint64)


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty without '://'."""
    _, there, rest = (url or "").partition("://")
    if not there:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    return rest[:end].encode().lower().decode(), path


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule and verdict for each row of pages(page_id, url, ...).

    A rule fits its host and all subdomains if the path starts with the rule's: to the automaton it is the glob "*.host", the
    host's end, "path*". Of the rules that fit, the longest decides, of equally long ones the first. If none fits, rule is
    null, and the verdict is block if a blocking glob matches, else allow. A null or malformed url has an empty host and
    path, which no rule fits. Repeated rows are judged alike; other columns are ignored; empty in, empty out.
    """
    rules = list(rules)
    names = [f"{host}{path}" for _, host, path in rules]
    ranked = sorted(range(len(rules)), key=lambda k: -len(names[k]))
    automaton = Automaton.of([f"*.{rules[k][1]}".encode() + HOST_END + f"{rules[k][2]}*".encode() for k in ranked] + list(block_globs))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, URLS_AT_ONCE):
                batch = whole.slice(at, URLS_AT_ONCE)
                parts = [host_and_path(u) for u in batch.column("url").to_pylist()]
                found = automaton.matches([f".{h}".encode() + HOST_END + p.encode() for h, p in parts])
                fits, globbed = found[:, : len(rules)], found[:, len(rules) :].any(axis=1)
                best = np.where(fits.any(axis=1), fits.argmax(axis=1) if len(rules) else 0, -1)
                rule = [names[ranked[k]] if k >= 0 else None for k in best]
                verdict = [rules[ranked[k]][0] if k >= 0 else "block" if g else "allow" for k, g in zip(best, globbed)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                    names=["page_id", "host", "path", "rule", "verdict"],
                )

    return pages.select("page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


def _like(glob: str) -> str:
    """The glob as LIKE text with the escape sign ^."""
    return "".join({"*": "%", "?": "_", "%": "^%", "_": "^_", "^": "^^"}.get(c, c) for c in glob)


#: The same for DuckDB; the sign between host and path is one that no glob names.
URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), r AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM q
), g AS (SELECT *, '.' || host || chr(1) || path AS u FROM r)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN """ + " OR ".join(f"u LIKE '{_like(g)}' ESCAPE '^'" for g in BLOCK_GLOBS) + r""" THEN 'block'
  ELSE 'allow' END AS verdict FROM g
"""  # fmt: skip

"""URL filters by a bit-parallel wildcard automaton.

All glob rules (``*`` any run, ``?`` one byte) are packed into one bit vector of as many 64-bit words as they need. A rule takes a bit for its
start and one for each byte it consumes; a ``*`` makes the bit before it hold itself. One Shift-And step over a URL's byte advances every rule
at once, and a batch of URLs is simulated side by side: state = ((state << 1) & mask[byte]) | (state & hold).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_slices

#: (rule, action): the production list. A URL is blocked if a block rule matches and no allow rule does.
RULES = [
    ("*://*.ads-track.*/*", "block"), ("*://ads-track.*/*", "block"), ("*://ad?.*", "block"), ("*doubleclick*", "block"), ("*utm_source=feed*utm_*", "block"),
    ("*/login*", "block"), ("*/logout*", "block"), ("*/signup*", "block"), ("*/cart*", "block"), ("*/checkout*", "block"), ("*/wp-admin/*", "block"), ("*/cgi-bin/*", "block"),
    ("*.exe", "block"), ("*.zip", "block"), ("*.jpg", "block"), ("*.png", "block"), ("*.gif", "block"), ("*.mp4", "block"), ("*.css", "block"), ("*.js", "block"),
    ("*casino*", "block"), ("*poker*", "block"), ("*porn*", "block"), ("*viagra*", "block"), ("*torrent*", "block"), ("*warez*", "block"),
    ("http://10.*", "block"), ("http://192.168.*", "block"), ("http://localhost*", "block"), ("*://*:*@*", "block"), ("*sessionid=*", "block"), ("*phpsessid=*", "block"), ("*replytocom=*", "block"),
    ("*?page=????*", "block"), ("*/print/*", "block"), ("*/tag/*/page/*", "block"), ("*://m.*.example.com/*", "block"), ("*://blog.*/??/1*", "block"),
    ("*://*.gov/*", "allow"), ("*://*.edu/*", "allow"), ("*://*/robots.txt", "allow"), ("*://www.*.example.org/*", "allow"),
]


#: What the states and matches of the URLs that are simulated at a time may take.
STATE_BYTES = 16 << 20


class Automaton:
    """The packed rules; match() gives (urls, rules) booleans."""

    def __init__(self, rules: Sequence[str]):
        self.n, bits, hold, start, last, masks = len(rules), 0, [], [], [], []
        for rule in rules:
            raw = rule.encode()
            start.append(bits)
            bits += 1
            for c in raw:
                if c == ord("*"):
                    hold.append(bits - 1)
                else:
                    masks.append((bits, c))
                    bits += 1
            last.append(bits - 1)
        self.words = max(1, -(-bits // 64))
        one = lambda at: (at >> 6, np.uint64(1 << (at & 63)))
        self.mask, self.hold, self.start = np.zeros((256, self.words), np.uint64), np.zeros(self.words, np.uint64), np.zeros(self.words, np.uint64)
        for at, c in masks:
            w, b = one(at)
            if c == ord("?"):
                self.mask[:, w] |= b
            else:
                self.mask[c, w] |= b
        for at in hold:
            w, b = one(at)
            self.hold[w] |= b
        for at in start:
            w, b = one(at)
            self.start[w] |= b
        self.last = np.array(last, np.int64)
        #: URLs that are simulated side by side: the more rules, the fewer, so that states and matches stay bounded.
        self.most = max(64, STATE_BYTES // (8 * self.words + self.n + 1))

    def match(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        lens, n = np.diff(offs), len(offs) - 1
        order = np.argsort(-lens, kind="stable")
        live = np.searchsorted(-lens[order], -np.arange(int(lens.max()) if n else 0), "left")
        state = np.tile(self.start, (n, 1))
        begin = offs[:-1][order]
        for i, k in enumerate(live.tolist()):
            s = state[:k]
            moved = s << np.uint64(1)
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            moved &= self.mask[data[begin[:k] + i]]
            s &= self.hold
            s |= moved
        got = (state[:, self.last >> 6] >> (self.last & 63).astype(np.uint64)) & np.uint64(1)
        out = np.empty((n, self.n), bool)
        out[order] = got.astype(bool)
        return out


def canonical(url: Column) -> Column:
    """Lower-case scheme and host (not the user before an @), no fragment, no default port, no trailing dot of the host, '/' for an empty path, spaces trimmed."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)
    user = F.regexp_extract(authority, "^(.*@)", 1)
    host = F.lower(F.regexp_replace(authority, "^.*@", ""))
    rest = F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, "\\.$", "")
    rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", u).otherwise(F.concat(scheme, F.lit("://"), user, host, rest))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """pages (page_id, url) -> (page_id, url, n_matched, matched, blocked): the canonical URL, how many rules match it, their texts joined by spaces in the order of the rules, and the decision.

    A NULL URL matches nothing and isn't blocked; an empty one only what matches the empty string. Repeated rows are decided each, an empty
    table gives no rows, extra columns are ignored. Rules may be repeated. URLs of any length are read to their end.
    """
    texts = [r for r, _ in rules]
    allow = np.array([a == "allow" for _, a in rules], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, said = Automaton(texts), {}
        for batch in batches:
            for first, last, data, offs in text_slices(batch.column(1), 1 << 17):
                for i in range(0, last - first, machine.most):
                    j = min(last - first, i + machine.most)
                    part = batch.slice(first + i, j - i)
                    null = part.column(1).is_null().to_numpy(zero_copy_only=False)
                    hit = machine.match(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    hit[null] = False
                    packed = [r.tobytes() for r in np.packbits(hit, axis=1)] if texts else [b""] * (j - i)
                    for p, r in zip(packed, hit):
                        if p not in said:
                            if len(said) > 100_000:
                                said.clear()
                            said[p] = " ".join(texts[x] for x in np.flatnonzero(r))
                    blocked = hit[:, ~allow].any(1) & ~hit[:, allow].any(1)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hit.sum(1), pa.int64()), pa.array([said[p] for p in packed], pa.string()), pa.array(blocked)], ["page_id", "url", "n_matched", "matched", "blocked"])

    return pages.select(F.col("page_id").cast("long"), canonical(F.col("url").cast("string")).alias("url")).mapInArrow(run, "page_id long, url string, n_matched long, matched string, blocked boolean")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' URLs by the production rules."""
    return filter_urls(read(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"({i}, '{r}', '{a}')" for i, (r, a) in enumerate(RULES))
OP5_SQL = f"""
WITH t AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
        regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)', 1) AS o, lower(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1), '^.*@', '')) AS h, regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS r FROM t),
c AS (SELECT page_id, CASE WHEN s = '' THEN u ELSE s || '://' || o || regexp_replace(CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END, '\\.$', '')
        || CASE WHEN starts_with(r, '/') THEN r ELSE '/' || r END END AS url FROM p),
rules(i, rule, action) AS (VALUES {_RULES_SQL})
SELECT c.page_id, c.url, count(i)::BIGINT AS n_matched, coalesce(string_agg(rule, ' ' ORDER BY i), '') AS matched,
       coalesce(bool_or(action = 'block'), false) AND NOT coalesce(bool_or(action = 'allow'), false) AS blocked
FROM c LEFT JOIN rules ON c.url GLOB rule GROUP BY c.page_id, c.url
"""

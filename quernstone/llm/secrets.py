"""Secret scan with one combined deterministic automaton.

All rules are compiled into one automaton (``automaton.compile_rules``) that reads a
text once, byte by byte, from its end, and is in an accepting state wherever a match of a
rule starts. So the pass gives the starts of all rules' matches; from the leftmost, the
rule's own automaton walks over the match to its longest end, and the next match is
the leftmost start behind it. Every byte is read once for all rules and once more for each
match that holds it: linear in the text, whatever it holds. Offsets are turned into
code points at the end. All of it is ASCII rules over UTF-8 bytes, so a match can
never begin or end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.automaton import Dfa, compile_rules, ends_at_once, longest_from
from quernstone.plans import map_arrow


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match is dropped if it is shorter than ``least``.

    lead: pattern of what stands before the secret itself; ``least`` then counts
    the bytes after it only. fold: letters match in either case.
    """

    kind: str
    pattern: str
    least: int = 0
    lead: str = ""
    fold: bool = False


_KEYWORD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

# The base kinds of the contract, in their order.
BASE_RULES = (
    Rule("assign", _KEYWORD + r"([A-Za-z0-9+/_.=-]+)", 12, _KEYWORD, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}", 16),  # runs: the shorter ones would be dropped
)

# Published formats of further credentials.
MORE_RULES = (
    Rule("pem", r"-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("dburl", r"(postgres|postgresql|mysql|mongodb|redis)://[A-Za-z0-9_.-]+:[A-Za-z0-9_.%-]+@[A-Za-z0-9.-]+", 12),
)

RULES = BASE_RULES + MORE_RULES


class Scanner:
    """The compiled rules and the walk over one text."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.joint: Dfa = compile_rules([(r.pattern, r.fold) for r in rules], starts=True)
        self.single = [compile_rules([(r.pattern, r.fold)], starts=False) for r in rules]
        self.leads = [compile_rules([(r.lead, r.fold)], starts=False) if r.lead else None for r in rules]
        for r, dfa in zip(rules, self.single, strict=True):
            if not ends_at_once(dfa):
                raise ValueError(f"rule {r.kind} may read on behind its match, which isn't linear")

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, accepting state) wherever a match of some rule starts, from the left, by one pass from the right."""
        step, state, first = self.joint.step, self.joint.start, self.joint.first_accepting
        found = []
        at = len(data)
        for b in reversed(data):
            at -= 1
            state = step[state + b]
            if state >= first:
                found.append((at, state))
        found.reverse()
        return found

    def byte_spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest matches without overlaps within a rule, short ones dropped."""
        out = []
        behind = [0] * len(self.rules)
        for at, state in self.starts(data):
            for r in self.joint.accepting[state]:
                if at >= behind[r]:
                    end = behind[r] = longest_from(self.single[r], data, at)
                    lead = self.leads[r]
                    if end - (longest_from(lead, data, at) if lead else at) >= self.rules[r].least:
                        out.append((at, end, r))
        return out

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start, then rule."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.byte_spans(data)
        if len(data) != len(text):
            marks, chars, last = {}, 0, 0
            for p in sorted({x for s, e, _ in found for x in (s, e)}):
                chars += sum(1 for c in data[last:p] if c & 0xC0 != 0x80)
                marks[p], last = chars, p
            found = [(marks[s], marks[e], r) for s, e, r in found]
        return sorted(found, key=lambda x: (x[0], x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for each input row.

    Null texts count as empty and have no spans; repeated rows are scanned as
    often as they occur; an empty table gives an empty result; other columns
    are ignored. Spans of one kind don't overlap, spans of different kinds may.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    # compiled once; a few MB, bounded by the rules
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(rules))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = [[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in scanner.spans(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, span)], names=["id", "spans"])

    id_type = src.schema["id"].dataType.simpleString()
    return map_arrow(src, scan, f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def digest(kinds: list[str], spans: list[tuple[str, int, int]]) -> str:
    """SHA-256 of kind:start:end by start, then kind as listed; the plain form of the query's digest."""
    listed = sorted((s, kinds.index(k), f"{k}:{s}:{e}") for k, s, e in spans if k in kinds)
    return hashlib.sha256(",".join(x[2] for x in listed).encode()).hexdigest()


def secret_report(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return spans.select(id_col, *[of(k) for k in base], F.sha2(F.array_join(F.transform(own, said), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", said), ",").alias("spans"))

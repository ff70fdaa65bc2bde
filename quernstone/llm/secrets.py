"""Secret scans with a trigram inverted index.

Each rule is a regular expression. A Boolean query over trigrams that any match must hold is
derived from its parse; documents are indexed by the trigrams that the queries use, postings
are intersected and united per rule, and only candidates are scanned with the rule's
expression. A rule without a mandatory trigram scans every document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import checkpointed, fresh, let, running

#: Candidates up to which they are broadcast, counted; a shuffle joins more. A set of strings larger than this is no longer carried along as exact strings.
BROADCAST_ROWS, MOST_STRINGS = 200_000, 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` with the same meaning in Python and Java; a match whose ``group`` is shorter than ``least`` is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules of the contract, in its order.
BASE = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What is found beyond them: private key headers and tokens of code hosts.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

# A query is True (anything), a trigram, or ("and" | "or", frozenset of queries).


def both(op: str, parts) -> object:
    flat = set()
    for p in parts:
        if p is True:
            if op == "or":
                return True
        elif isinstance(p, tuple) and p[0] == op:
            flat |= p[1]
        else:
            flat.add(p)
    if op == "or":  # a or (a and b) is a
        sets = {p: p[1] if isinstance(p, tuple) and p[0] == "and" else frozenset([p]) for p in flat}
        flat = {p for p in flat if not any(sets[o] < sets[p] for o in flat)}
    if not flat:
        return True
    return flat.pop() if len(flat) == 1 else (op, frozenset(flat))


def of_string(s: str) -> object:
    return both("and", {s[i : i + 3] for i in range(len(s) - 2)})


def of_strings(strings: set[str] | None) -> object:
    return True if strings is None else both("or", [of_string(s) for s in strings])


def folded(code: int) -> str:
    c = chr(code)
    return c.lower() if c.isascii() else c


def strings_of(node) -> set[str] | None:
    """The strings that a node matches, lower-cased; None if they are too many."""
    op, arg = node
    if op is rc.LITERAL:
        return {folded(arg)}
    if op is rc.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                out.add(folded(x))
            elif kind is rc.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {folded(c) for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is rc.SUBPATTERN:
        return strings_of_all(list(arg[-1]))
    if op is rc.BRANCH:
        got = [strings_of_all(list(x)) for x in arg[1]]
        return None if None in got or sum(map(len, got)) > MOST_STRINGS else set().union(*got)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] != rc.MAXREPEAT and arg[1] <= 5:
        one = strings_of_all(list(arg[2]))
        if one is None:
            return None
        out, power = set(), {""}
        for n in range(arg[1] + 1):
            if n >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power) > MOST_STRINGS:
                return None
        return out
    return None


def strings_of_all(nodes: list) -> set[str] | None:
    out = {""}
    for node in nodes:
        got = strings_of(node)
        if got is None or len(out) * len(got) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in got}
    return out


def trigram_query(pattern: str) -> object:
    """What any match must hold, in lower case: True, a trigram, or ("and" | "or", queries)."""
    return of_nodes(list(rp.parse(pattern)))


def of_nodes(nodes: list) -> object:
    found, held = [], {""}
    for node in nodes:
        got = strings_of(node)
        if got is not None and len(held) * len(got) <= MOST_STRINGS:
            held = {a + b for a in held for b in got}
            continue
        found.append(of_strings(held))
        held = got if got is not None else {""}
        if got is None:
            op, arg = node
            if op is rc.SUBPATTERN:
                found.append(of_nodes(list(arg[-1])))
            elif op is rc.BRANCH:
                found.append(both("or", [of_nodes(list(x)) for x in arg[1]]))
            elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] > 0:
                found.append(of_nodes(list(arg[2])))
    found.append(of_strings(held))
    return both("and", found)


def trigrams_in(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``(trigram, id)``: which documents hold which of the trigrams that the rules ask for, case folded.

    One pass over each text looks for those trigrams only. A null text holds none.
    """
    wanted = sorted(set().union(*(trigrams_in(trigram_query(r.pattern)) for r in rules)))
    low = docs.select(F.col(id).alias("id"), F.lower(text).alias("low"))
    present = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])
    return low.select("id", F.explode(F.filter(present, lambda t: t.isNotNull())).alias("trigram")).select("trigram", "id")


def satisfied(query, held: str) -> Column:
    """Whether a set of trigrams, the array ``held``, satisfies a query."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [satisfied(q, held) for q in sorted(query[1], key=repr)]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(id, kinds)``: the rules with mandatory trigrams whose query a document's postings satisfy.

    Postings meet by document; a document has at most as many as the rules have trigrams.
    """
    held = postings.groupBy("id").agg(F.collect_set("trigram").alias("held"))
    kinds = [F.when(satisfied(q, "held"), F.lit(r.kind)) for r in rules if (q := trigram_query(r.pattern)) is not True]
    kinds = F.filter(F.array(*kinds), lambda k: k.isNotNull()) if kinds else F.array().cast("array<string>")
    return held.select("id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def matches(text: Column, rule: Rule) -> Column:
    """``(start, kind, end)`` in code points of the rule's leftmost non-overlapping matches that pass.

    Matches and the pieces between them alternate; their lengths summed up are the places.
    """
    pattern, least = rule.pattern, rule.least
    if rule.group == 0 and least > 1 and pattern.endswith("]+"):
        # a greedy run: shorter ones fail wherever they start, so the engine may skip them
        fixed = len(strings_head(pattern))
        pattern, least = f"{pattern[:-1]}{{{least - fixed},}}", 1
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group))
    found = F.struct(whole.alias("m"), judged.alias("j"), F.split(text, pattern, -1).alias("g"))
    size = lambda f, m, i: F.struct(F.length(F.get(f["g"], i)).alias("gap"), F.length(m).alias("n"), F.length(F.get(f["j"], i)).alias("judged"))

    def placed(sizes: Column) -> Column:
        before = running(F.transform(sizes, lambda t: t["gap"] + t["n"]))
        each = F.zip_with(sizes, before, lambda t, at: F.struct((at + t["gap"]).cast("int").alias("at"), t["n"].alias("n"), t["judged"].alias("judged")))
        return F.transform(F.filter(each, lambda t: t["judged"] >= least), lambda t: F.struct(t["at"].alias("start"), F.lit(rule.kind).alias("kind"), (t["at"] + t["n"]).alias("end")))

    none = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    return F.when(F.rlike(text, F.lit(pattern)), let(found, lambda f: let(F.transform(f["m"], lambda m, i: size(f, m, i)), placed))).otherwise(none)


def strings_head(pattern: str) -> str:
    """The literal characters that a pattern starts with."""
    nodes = list(rp.parse(pattern))
    return "".join(chr(arg) for op, arg in nodes if op is rc.LITERAL)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: ``(start, kind, end)`` of each secret, by start, then kind as listed.

    The index names each rule's candidates; the others get no span of that rule without a scan.
    A null text is an empty one; rows with a null id are candidates of every rule. Repeated ids
    share candidates, each row is verified on its own text. Empty tables give no rows. A column named
    ``into`` is replaced; other columns come back as they were, whatever their names. Texts are only
    shuffled where more than BROADCAST_ROWS documents are candidates.
    """
    docs = docs.drop(into)
    of_id, kinds = fresh([*docs.columns, into], "id", "kinds")
    named = checkpointed(candidates(index(docs, rules, id, text), rules)).toDF(of_id, kinds)
    small = named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = docs.join(F.broadcast(named) if small else named, F.col(id) == F.col(of_id), "left")
    empty = F.array().cast("array<struct<start:int,kind:string,end:int>>")
    found, whole = [], F.coalesce(F.col(text), F.lit(""))
    for r in rules:
        got = matches(whole, r)
        if trigram_query(r.pattern) is not True:
            got = F.when(F.col(id).isNull() | F.coalesce(F.array_contains(kinds, r.kind), F.lit(False)), got).otherwise(empty)
        found.append(got)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])

    def order(a: Column, b: Column) -> Column:
        ka, kb = rank[a["kind"]], rank[b["kind"]]
        return F.when(a["start"] != b["start"], a["start"] - b["start"]).when(ka != kb, ka - kb).otherwise(a["end"] - b["end"])

    return joined.withColumn(into, F.array_sort(F.concat(*found), order)).drop(of_id, kinds)


def shown(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(scanned: DataFrame, id: str = "doc_id") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of scan()'s rows."""
    base = [r.kind for r in BASE]
    counted = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = [counted(k) for k in base]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scanned.select(F.col(id).alias("doc_id"), *n, F.sha2(shown(own), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(scanned: DataFrame, text: str = "text", mask: str = "[SECRET]", spans: str = "spans") -> DataFrame:
    """scan()'s rows with every span, overlapping ones as one, replaced by ``mask``; the spans go.

    Rows without a span keep their text, a null one too.
    """
    # spans are in order: what stands between the furthest end so far and the next start stays
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.lit(mask))
        inside = (s["start"] < acc["at"]) & (acc["at"] > 0)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    cleaned = F.aggregate(spans, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text, F.when(F.size(spans) > 0, cleaned).otherwise(F.col(text))).drop(spans)

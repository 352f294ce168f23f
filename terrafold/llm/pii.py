"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything is a column expression. A pattern's matches and the pieces between them come from ``regexp_extract_all`` and
``split``, and their lengths give the positions (code points, end exclusive). Repetitions are possessive and starts
are anchored at the head of a run, which finds the same leftmost matches as the plain forms, in linear time and without
recursion on long texts.

The first four kinds are the base: a match that fails its check is dropped, and none is dropped for its score. Further
kinds need a score of at least ``THRESHOLD``: IBANs confirmed by mod 97, social security numbers and phone numbers
without ``+`` confirmed by words nearby. Null is the empty text, which has no spans; repeated rows are scored alike;
an empty table gives an empty result; the columns of the input stay, and a result column replaces one of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

THRESHOLD = 0.5
#: Characters before and after a span in which context words count.
BEFORE, AFTER = 40, 20
#: Code points of a piece of text; windows and what stands between spans are cut from such pieces, not from the whole.
CHUNK = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str  # a cheap pattern that every text with a valid match holds
    check: str  # SQL condition on the match m
    score: float
    context: str
    base: bool = False
    ahead: bool = False  # the pattern is a lookahead whose group 1 is the match, so each start is tried


OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DIGITS = "regexp_replace(m, '[^0-9]', '')"
LUHN = (
    f"length({DIGITS}) between 13 and 19 and aggregate(sequence(1, length({DIGITS})), 0, (a, i) -> a + "
    f"if(i % 2 = 1, int(substr(reverse({DIGITS}), i, 1)), "
    f"int(substr('0246813579', int(substr(reverse({DIGITS}), i, 1)) + 1, 1)))) % 10 = 0"
)
COMPACT = "replace(m, ' ', '')"
MOD97 = (
    f"length({COMPACT}) between 15 and 34 and aggregate(split(concat(substr({COMPACT}, 5), left({COMPACT}, 4)), ''), 0, "
    "(a, c) -> if(c = '', a, if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97))) = 1"
)
#: Countries of each IBAN length.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Known countries have their length; others end where their run does.
IBAN = "|".join(
    [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items()]
    + [rf"(?!{'|'.join(IBAN_LENGTHS.values()).replace(' ', '|')})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"]
)
LOCAL = "[A-Za-z0-9._%+-]"

KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "true", 0.9,
         "mail|contact|write|reply", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]",
         rf"m rlike '^{OCTET}(\\.{OCTET}){{3}}$'", 0.7, "ip|host|address|server|login", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){12}", LUHN, 0.9,
         "card|visa|master|credit|pay|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", f"length({DIGITS}) between 9 and 15", 0.7,
         "phone|call|tel|mobile|fax|contact", True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=((?:{IBAN})(?![A-Za-z0-9])))", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]",
         MOD97, 0.9, "iban|account|bank|konto|compte|cuenta", ahead=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}",
         "not m rlike '^(000|666|9)|-00-|-0000$'", 0.3, "ssn|social|security"),
    Kind("local_phone", r"(?<![0-9+(.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
         r"[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", "true", 0.3, "phone|call|tel|mobile|fax"),
)
#: Words that make a number look like no personal datum.
AGAINST = "version|order|invoice|isbn|serial|example"
SPAN = "struct<kind:string,start:bigint,stop:bigint,score:double>"


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(items: str, state: str, emitted: str, step: str, emit: str) -> str:
    """SQL of a fold over an array that emits arrays: ``step`` moves the state s.at past x, ``emit`` is what x adds.

    The array is taken in blocks of about the root of its size and the blocks' results are flattened at the end, so that
    no long array is copied for each item.
    """
    inner = (
        f"aggregate(slice(xs, b * width + 1, width), named_struct('at', a.at, 'out', cast(array() as array<{emitted}>)), "
        f"(s, x) -> named_struct('at', {step}, 'out', concat(s.out, {emit})))"
    )
    outer = (
        f"aggregate(sequence(0, (size(xs) - 1) div width), named_struct('at', {state}, 'out', cast(array() as array<array<{emitted}>>)), "
        f"(a, b) -> transform(array({inner}), r -> named_struct('at', r.at, 'out', concat(a.out, array(r.out))))[0])"
    )
    blocks = f"transform(array(int(ceil(sqrt(size(xs))))), width -> {outer})[0]"
    return f"transform(array({items}), xs -> if(size(xs) = 0, cast(array() as array<{emitted}>), flatten({blocks}.out)))[0]"


def cut(start: str, stop: str) -> str:
    """SQL of the text between two code points, from the ``CHUNK``-long pieces of the text that hold them."""
    held = f"slice(__chunks, int(({start}) div {CHUNK}) + 1, int(greatest({stop} - 1, {start}) div {CHUNK} - ({start}) div {CHUNK}) + 1)"
    return f"substr(array_join({held}, ''), int(({start}) % {CHUNK}) + 1, int(({stop}) - ({start})))"


def spans_of(kind: Kind, pieces: str, matches: str) -> Column:
    """Checked and scored spans of one kind from the split pieces and the matches of its pattern."""
    around = f"lower(concat({cut(f'greatest(x.start - {BEFORE}, 0L)', 'x.start')}, ' ', {cut('x.stop', f'x.stop + {AFTER}')}))"
    score = (
        f"round({kind.score} + if({around} rlike {literal(r'\b(?:' + kind.context + ')')}, 0.3, 0) "
        f"- if({around} rlike {literal(r'\b(?:' + AGAINST + r')\b')}, 0.2, 0), 4)"
    )
    if kind.ahead:  # a split at a lookahead has no empty piece before a match at 0
        pieces = f"if(size({pieces}) > size({matches}), {pieces}, concat(array(''), {pieces}))"
    steps = f"zip_with(slice({pieces}, 1, size({matches})), {matches}, (p, m) -> named_struct('skip', length(p), 'm', m, 'n', length(m)))"
    taken = "0" if kind.ahead else "x.n"
    placed = fold(
        steps, "0L", "struct<m:string,start:bigint,stop:bigint>", f"s.at + x.skip + {taken}",
        "array(named_struct('m', x.m, 'start', s.at + x.skip, 'stop', s.at + x.skip + x.n))",
    )
    checked = f"filter({placed}, x -> exists(array(x.m), m -> {kind.check}))"
    if kind.ahead:  # the next span begins after the one confirmed before
        free = "x.start >= s.at"
        checked = fold(checked, "0L", "struct<m:string,start:bigint,stop:bigint>", f"if({free}, x.stop, s.at)", f"if({free}, array(x), array())")
    scored = f"transform({checked}, x -> named_struct('kind', '{kind.name}', 'start', x.start, 'stop', x.stop, 'score', cast({score} as double)))"
    if not kind.base:
        scored = f"filter({scored}, x -> x.score >= {THRESHOLD})"
    return F.expr(f"if(size({matches}) > 0, {scored}, cast(array() as array<{SPAN}>))")


def find(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The input with ``pii``: its spans by kind in the order of ``kinds``, then start."""
    return spanned(docs, text_col, kinds, "pii").drop("__chunks")


def spanned(docs: DataFrame, text_col: str, kinds: tuple[Kind, ...], out_col: str) -> DataFrame:
    """The input with its spans and with ``__chunks``, the pieces of its text (none without a match)."""
    kept = [c for c in docs.columns if c != out_col]
    text = "__text"
    df = docs.select(*[F.col(f"`{c}`") for c in kept], whole(F.col(f"`{text_col}`")).alias(text))
    none = F.array().cast("array<string>")
    df = df.withColumns({
        f"__m_{k.name}": F.when(F.col(text).rlike(k.gate), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(int(k.ahead)))).otherwise(none)
        for k in kinds
    })
    some = " or ".join(f"size(__m_{k.name}) > 0" for k in kinds)
    df = df.withColumns({
        f"__p_{k.name}": F.when(F.size(f"__m_{k.name}") > 0, F.split(text, k.pattern, -1)).otherwise(none) for k in kinds
    } | {"__chunks": F.when(F.expr(some), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))).otherwise(none)})
    found = [spans_of(k, f"__p_{k.name}", f"__m_{k.name}") for k in kinds]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.concat(*found).alias(out_col), "__chunks")


def joined(spans: str, names: list[str] | None = None) -> Column:
    """kind:start:stop of the spans, comma-joined; of the named kinds only, if given."""
    if names is not None:
        spans = f"filter({spans}, x -> x.kind in ({', '.join(literal(n) for n in names)}))"
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and span lists of each document."""
    base = [k.name for k in KINDS if k.base]
    return find(docs.select("doc_id", "text")).select(
        "doc_id",
        *[F.expr(f"cast(size(filter(pii, x -> x.kind = '{n}')) as bigint)").alias(f"n_{n}") for n in base],
        F.sha2(joined("pii", base), 256).alias("base_sha256"),
        joined("pii").alias("spans"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with each span's text replaced by its kind in brackets; overlapping spans become one, the first's."""
    spans = "__pii"
    while spans in docs.columns:
        spans += "_"
    in_order = (
        f"array_sort({spans}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 "
        "when a.stop > b.stop then -1 when a.stop < b.stop then 1 else 0 end)"
    )
    # The last item stands for the end of the text and adds what is left of it.
    ended = f"concat({in_order}, array(named_struct('kind', '', 'start', bigint(length(`{text_col}`)), 'stop', bigint(length(`{text_col}`)), 'score', 0D)))"
    add = f"if(x.kind = '', array({cut('s.at', 'x.start')}), if(x.start < s.at, array(), array({cut('s.at', 'x.start')}, concat('[', upper(x.kind), ']'))))"
    text = F.expr(f"array_join({fold(ended, '0L', 'string', 'greatest(s.at, x.stop)', add)}, '')")
    found = spanned(docs, text_col, KINDS, spans)
    return found.select(*[F.when(F.size(spans) > 0, text).otherwise(F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

"""Column functions over text: normal forms, labels, money, currencies, dates, numbers and keys."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V

MONEY = "decimal(18,2)"
_AMOUNT = r"[0-9][0-9.,]*+"
#: Amounts that need no look at their signs: digits alone, or thousands by comma and one or two decimals behind a point.
_PLAIN_AMOUNT = r"^(?:[0-9]{1,12}|[0-9]{1,3}(?:,[0-9]{3}){0,3}\.[0-9]{1,2})$"
#: A plain amount that is the first number of a text and stands behind a common currency sign, so that no earlier one has to be sought.
_LEADING_AMOUNT = r"(?i)^[^0-9]*+(?<=(?:Rp\.?|IDR\.?|USD|EUR|\$|€)\s{0,2})([0-9]{1,12}+|[0-9]{1,3}+(?:,[0-9]{3}){0,3}+\.[0-9]{1,2}+)(?![0-9.,]|\s*%)"
#: One that is the last number too.
_ONLY_AMOUNT = _LEADING_AMOUNT + r"[^0-9]*+\z"
#: What any amount with a currency holds: a sign's last character before a digit, or a code's first one behind an amount. Dates and numbers seldom do.
_NEAR_CURRENCY = r"(?i)[PRDYBWMFL.$€£¥₩₹฿₱₫]\s*[0-9]|[0-9.,]\s*[IUSACNHREGJKMTPVBZ]"
#: Formats after all separators have become blanks, day first.
_DATE_FORMATS = [(r"^\d{4} \d{1,2} \d{1,2}$", "yyyy M d"), (r"^\d{1,2} \d{1,2} \d{4}$", "d M yyyy"), (r"^\d{1,2} \d{1,2} \d{2}$", "d M yy")] + [
    (rf"^{order}$", fmt)
    for order, fmt in (
        (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
        (r"\d{1,2} [A-Za-z]{3} \d{2}", "d MMM yy"),
        (r"\d{1,2} [A-Za-z]{4,} \d{4}", "d MMMM yyyy"),
        (r"\d{1,2} [A-Za-z]{4,} \d{2}", "d MMMM yy"),
        (r"[A-Za-z]{3} \d{1,2} \d{4}", "MMM d yyyy"),
        (r"[A-Za-z]{4,} \d{1,2} \d{4}", "MMMM d yyyy"),
    )
]


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a one-element transform. Written out, each use of value would repeat its expression."""
    return F.get(F.transform(F.array(value), body), 0)


def _sql(value) -> str:
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value}D" if isinstance(value, float) else str(value)


def constant(values: list | dict) -> Column:
    """A list (of texts or of records) or a map of texts; made of literals only, so the optimizer folds it into one."""
    if isinstance(values, dict):
        return F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in values.items()) + ")")
    return F.expr("array(" + ", ".join(map(_sql, values)) + ")")


def none_if_empty(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def norm(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits squeezed to single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def norm_label(c: Column) -> Column:
    """norm with misread label words put right."""
    fixed, normal = constant(V.LABEL_TYPOS), norm(c)
    mended = F.array_join(F.transform(F.split(normal, " "), lambda w: F.coalesce(F.try_element_at(fixed, w), w)), " ")
    return F.when(normal.rlike(f"(?<![^ ]){_any_of(list(V.LABEL_TYPOS))}(?![^ ])"), mended).otherwise(normal)


def folded(c: Column) -> Column:
    """Only ASCII letters and digits, lower case: for containment across layout differences."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z]+", "")


def label_part(line: Column) -> Column:
    return none_if_empty(F.regexp_extract(line, r"^\s*(.+?)\s*[:=]\s*(.+?)\s*$", 1))


def value_part(line: Column) -> Column:
    return none_if_empty(F.regexp_extract(line, r"^\s*(.+?)\s*[:=]\s*(.+?)\s*$", 2))


def has_words(normal: Column, phrase: Column) -> Column:
    """phrase stands in normal as whole words."""
    return F.contains(F.concat(F.lit(" "), normal, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def starts_words(normal: Column, phrase: Column) -> Column:
    return F.startswith(F.concat(normal, F.lit(" ")), F.concat(phrase, F.lit(" ")))


def parse_money(raw: Column) -> Column:
    """The later of comma and point is the decimal sign; a sign alone is one if at most two digits follow its last occurrence."""
    plain = let(F.regexp_replace(F.trim(raw), "[^0-9,.-]", ""), _one_decimal_sign)
    general = let(plain, lambda c: F.when(c.rlike(r"^-?\d*\.?\d*$") & c.rlike(r"\d"), c.try_cast(MONEY)))
    return F.when(raw.rlike(_PLAIN_AMOUNT), F.replace(raw, F.lit(",")).try_cast(MONEY)).otherwise(general)


def _one_decimal_sign(c: Column) -> Column:
    commas, points = F.length(c) - F.length(F.replace(c, F.lit(","))), F.length(c) - F.length(F.replace(c, F.lit(".")))
    no_commas, no_points = F.replace(c, F.lit(",")), F.replace(c, F.lit("."))
    last_comma, last_point = F.locate(",", F.reverse(c)), F.locate(".", F.reverse(c))  # digits behind it + 1

    def alone(last: Column, bare: Column) -> Column:
        cut = F.length(bare) - last + 1
        return F.when(last <= 3, F.concat(F.substr(bare, F.lit(1), cut), F.lit("."), F.substr(bare, cut + 1))).otherwise(bare)

    return (
        F.when((commas > 0) & (points > 0) & (last_comma < last_point), F.replace(no_points, F.lit(","), F.lit(".")))
        .when((commas > 0) & (points > 0), no_commas)
        .when(commas > 0, alone(last_comma, no_commas))
        .when(points > 0, alone(last_point, no_points))
        .otherwise(c)
    )


def money_raw(text: Column, first: bool = False) -> Column:
    """The first or last amount with a currency, else the last bare number, as written."""
    tagged = F.filter(F.transform(F.regexp_extract_all(text, F.lit(V.CURRENCY_AMOUNT), F.lit(0)), lambda m: F.regexp_extract(m, _AMOUNT, 0)), lambda r: r.rlike(_PLAIN_AMOUNT) | parse_money(r).isNotNull())
    bare = F.regexp_extract_all(text, F.lit(V.BARE_AMOUNT), F.lit(1))
    last_bare = F.try_element_at(bare, F.lit(-1))
    found = F.coalesce(F.try_element_at(tagged, F.lit(1 if first else -1)), last_bare)
    # The common cases need no list of amounts: one anchored search finds it, there is no sign at all, or the first amount is wanted and plain.
    seek = lambda tag: F.when(tag == "", last_bare).otherwise(let(F.regexp_extract(tag, _AMOUNT, 0), lambda a: F.when(a.rlike(_PLAIN_AMOUNT), a).otherwise(found)) if first else found)
    plain = F.regexp_extract(text, _LEADING_AMOUNT if first else _ONLY_AMOUNT, 1)
    return let(plain, lambda amount: F.when(amount != "", amount).otherwise(let(F.when(text.rlike(_NEAR_CURRENCY), F.regexp_extract(text, V.CURRENCY_AMOUNT, 0)).otherwise(""), seek)))


def money(text: Column, first: bool = False) -> Column:
    return parse_money(money_raw(text, first))


def currency(text: Column) -> Column:
    """ISO code of the first amount's currency sign, or null."""
    sign = F.regexp_replace(F.regexp_extract(text, V.CURRENCY_SIGN_AMOUNT, 0), r"[0-9.,\s]+", "")  # what isn't the amount
    codes = constant(V.CURRENCY_CODES)
    return F.when(text.rlike(_NEAR_CURRENCY), let(F.upper(sign), lambda bare: F.when(bare != "", F.coalesce(F.try_element_at(codes, bare), bare))))


def has_currency_amount(text: Column) -> Column:
    """An amount with its currency stands in the text."""
    return text.rlike(_NEAR_CURRENCY) & text.rlike(V.CURRENCY_SIGN_AMOUNT)


def parse_date(text: Column) -> Column:
    """The first date in the text, day before month; two-digit years from 69 on belong to the last century."""
    months = constant(V.MONTHS)

    def english(token: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.replace(token, F.lit(",")), r"[./\-\s]+", " "))
        worded = F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(months, F.lower(w)), w)), " ")
        return F.when(token.rlike("[A-Za-z]"), worded).otherwise(plain)

    def parsed(c: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(None).cast("date"))
        for shape, fmt in _DATE_FORMATS:
            chain = chain.when(c.rlike(shape), F.to_date(F.try_to_timestamp(c, F.lit(fmt))))
        short = c.rlike(r"(?:^|\s)\d{2}$") & ~c.rlike(r"\d{4}")
        return let(chain, lambda d: F.when(short & (F.year(d) > 2068), F.add_months(d, -1200)).otherwise(d))

    return let(F.regexp_extract(text, V.DATE_TOKEN, 0), lambda token: F.when(token != "", let(english(token), parsed)))


def clean_number(value: Column) -> Column:
    """Blanks around separators removed, other blanks squeezed."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\s*([/._\-])\s*", "$1"), r"\s+", " ")


def parse_document_number(value: Column) -> Column:
    """The value as a number, or the longest number-like part of it; dates, amounts and percentages are none."""
    refused = parse_date(value).isNotNull() | has_currency_amount(value) | F.contains(value, F.lit("%"))
    bare = clean_number(F.regexp_replace(value, r"(?i)^\s*(?:no\.?|number|nomor|id|code|reference|ref)\s*[:#\-]?\s*", ""))
    return F.when(~refused, let(bare, _number_in))


def _number_in(bare: Column) -> Column:
    whole = (F.length(bare) <= 80) & bare.rlike(r"(?i)^[A-Z0-9][A-Z0-9 _/#.()\-]*\d[A-Z0-9 _/#.()\-]*$")
    parts = F.regexp_extract_all(bare, F.lit(r"(?i)((?<![A-Z0-9])(?=[A-Z0-9/.\-]*\d)[A-Z0-9][A-Z0-9/.\-]{2,})"), F.lit(1))
    longest = F.try_element_at(F.filter(parts, lambda p: F.length(p) == F.array_max(F.transform(parts, lambda p: F.length(p)))), F.lit(1))
    return F.when(whole, bare).otherwise(longest)


def number_is_safe(value: Column) -> Column:
    """A number near a label, without the label's own line: six digits, or letters and digits."""
    return value.rlike(r"^\d{6,}$") | (value.rlike("[A-Za-z]") & value.rlike(r"\d"))


def looks_like_address(text: Column) -> Column:
    return F.arrays_overlap(F.split(norm(text), " "), F.array(*[F.lit(w) for w in V.ADDRESS_WORDS]))


def first_phrase(normal: Column, phrases: list[str]) -> Column:
    """The first of phrases that normal contains."""
    any_of = "|".join(map(re.escape, phrases))
    return F.when(normal.rlike(any_of), F.get(F.filter(constant(phrases), lambda p: F.contains(normal, p)), 0))


def _role_struct(role: str, score: float):
    return lambda phrase: F.when(phrase.isNotNull(), F.struct(F.lit(role).alias("role"), phrase.alias("label"), F.lit(score).alias("score")))


def _layers(phrases: list[str]) -> list[list[str]]:
    """Phrases parted so that none begins another of its part: at one word of a text at most one phrase of a part stands."""
    words = {p: p.split() for p in phrases}
    layers: dict[int, list[str]] = {}
    for p in words:
        layers.setdefault(sum(words[q] == words[p][: len(words[q])] for q in words if q != p), []).append(p)
    return [layers[depth] for depth in sorted(layers)]


def _any_of(phrases: list[str]) -> str:
    """A pattern of phrases that share their common beginnings; tried phrase by phrase, a text would be read once for each."""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        heads.setdefault(p[:1], []).append(p[1:])
    ways = [re.escape(c) + (re.escape(rests[0]) if len(rests) == 1 else _any_of(rests)) for c, rests in heads.items() if c]
    return f"(?:{'|'.join(ways)}){'?' if '' in heads else ''}" if ways else ""


def phrases_in(normal: Column, phrases: list[str], at_start: bool = False) -> Column:
    """Every one of phrases that normal holds, or begins with, as whole words; each pattern finds those of one layer at every word."""
    place = "^" if at_start else "(?:^|(?<= ))"
    patterns = [f"{place}(?=({_any_of(layer)})(?: |$))" for layer in _layers(phrases)]
    return F.concat(*[F.regexp_extract_all(normal, F.lit(p), F.lit(1)) for p in patterns])


def _entries(phrases: Column, table: dict[str, dict]) -> Column:
    """The records of phrases, which carry their place in the order of the table."""
    known = constant({p: {"place": i} | entry for i, (p, entry) in enumerate(table.items())})
    return F.transform(phrases, lambda p: F.try_element_at(known, p))


#: Label phrases of amounts in the order in which they decide: roles that aren't payable, then the payable total.
_AMOUNT_PHRASES: dict[str, dict] = {}
for _role, _score, _phrases in [*V.AMOUNT_ROLES, *(("final_total", s, [a]) for f, a, s in V.LABEL_ALIASES if f == "transaction_amount")]:
    for _phrase in _phrases:
        _AMOUNT_PHRASES.setdefault(_phrase, {"role": _role, "label": _phrase, "score": _score})


def amount_role(line: Column) -> Column:
    """struct(role, label, score) of a line: roles that aren't payable first, then the payable total; null if none."""
    return let(norm_label(line), amount_role_of)


def amount_role_of(normal: Column) -> Column:
    """amount_role of a line in the form of norm_label."""
    return role_among(phrases_in(normal, list(_AMOUNT_PHRASES)), normal)


def role_among(phrases: Column, normal: Column) -> Column:
    """The role that the first of phrases in the order of amount roles gives a line in the form of norm_label."""
    return _role_of(F.array_min(_entries(phrases, _AMOUNT_PHRASES)), normal)


def _role_of(entry: Column, normal: Column) -> Column:
    def role(first: Column) -> Column:
        cap = F.when(first["role"] != "final_total", 1.0).when(starts_words(normal, first["label"]), 0.98).otherwise(0.95)
        return F.when(first.isNotNull(), F.struct(first["role"].alias("role"), first["label"].alias("label"), F.least(first["score"], cap).alias("score")))

    return let(entry, role)


_ALIASES = {a: {"field": f, "alias": a, "score": s} for f, a, s in V.LABEL_ALIASES}


def _placed(table: dict[str, dict], phrase: str) -> str:
    """The record of a phrase with its place in the order of the table, or a null of that kind, in SQL."""
    of = lambda p: _sql({"place": list(table).index(p)} | table[p])
    return of(phrase) if phrase in table else f"if(false, {of(next(iter(table)))}, null)"




_KNOWN = {
    p: f"named_struct('phrase', {_sql(p)}, 'role', {_placed(_AMOUNT_PHRASES, p)}, 'alias', {_placed(_ALIASES, p)})" for p in _AMOUNT_PHRASES | _ALIASES
}
#: Phrases that hold digits.
DIGIT_PHRASES = [p for p in [*_KNOWN, *(p for _, _, phrases in V.DATE_ROLES for p in phrases)] if re.search("[0-9]", p)]
#: With each phrase those that it begins with: the longest at a word tells all that stand there.
_BEGUN = {p: [q for q in _KNOWN if f"{p} ".startswith(f"{q} ")] for p in _KNOWN}


def known_phrases(normal: Column) -> Column:
    """The phrases of amount roles and the label aliases that a line in the form of norm_label holds as whole words, each looked up once:
    array of struct(phrase, role, alias), of which role or alias is null where the phrase is none."""
    # A map is searched entry by entry, so there is one for each length of phrases.
    per_length = [[p for p in _BEGUN if len(p) == n] for n in range(max(map(len, _BEGUN)) + 1)]
    shape = next(iter(_KNOWN.values()))
    maps = [f"map({', '.join(f'{_sql(p)}, array({", ".join(_KNOWN[q] for q in _BEGUN[p])})' for p in own)})" if own else f"map('', array({shape}))" for own in per_length]
    known = F.expr(f"array({', '.join(maps)})")
    longest = F.regexp_extract_all(normal, F.lit(f"(?<![^ ])(?=({_any_of(list(_KNOWN))})(?![^ ]))"), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(longest, lambda p: F.try_element_at(F.get(known, F.length(p)), p))))


def known_in(known: Column, normal: Column) -> Column:
    """Those known phrases of a line that a part of it, in the form of norm_label, holds as whole words."""
    return F.filter(known, lambda k: has_words(normal, k["phrase"]))


def role_known(known: Column, normal: Column) -> Column:
    """role_among for known phrases."""
    return _role_of(F.array_min(F.transform(known, lambda k: k["role"])), normal)


def field_known(known: Column, normal: Column) -> Column:
    """label_field of a label whose line's known phrases are given."""
    first = F.array_min(F.transform(F.filter(known, lambda k: starts_words(normal, k["phrase"])), lambda k: k["alias"]))
    return F.when(F.length(normal) <= 80, let(first, _plain_alias))


def aliases_among(known: Column) -> Column:
    """array of struct(field, alias, score, priority) of those known phrases that are label aliases."""
    found = F.filter(known, lambda k: k["alias"].isNotNull())
    return F.transform(found, lambda k: F.struct(k["alias"]["field"].alias("field"), k["phrase"].alias("alias"), k["alias"]["score"].alias("score"), k["alias"]["place"].alias("priority")))


def date_role(text: Column) -> Column:
    """struct(role, label, score) of a line, or null."""
    held = _any_of([p for _, _, phrases in V.DATE_ROLES for p in phrases])
    return let(norm(text), lambda n: F.when(n.rlike(held), F.coalesce(*[let(first_phrase(n, phrases), _role_struct(role, score)) for role, score, phrases in V.DATE_ROLES])))


def label_field(label: Column) -> Column:
    """struct(field, alias, score): the first alias, in order, that a label equals or begins with; null if none."""
    first = lambda normal: F.array_min(_entries(phrases_in(normal, list(_ALIASES), at_start=True), _ALIASES))
    return let(norm_label(label), lambda normal: F.when(F.length(normal) <= 80, let(first(normal), _plain_alias)))


def _plain_alias(e: Column) -> Column:
    return F.when(e.isNotNull(), F.struct(e["field"].alias("field"), e["alias"].alias("alias"), e["score"].alias("score")))


def label_allowed(field: Column, normal: Column, doc_type: Column | None = None) -> Column:
    """Whether a label may name the field: foreign numbers and partial amounts may not."""
    has = lambda ws: reduce(lambda a, w: a | F.contains(normal, F.lit(w)), ws, F.lit(False))
    tax_document = F.lit(False) if doc_type is None else F.upper(F.coalesce(doc_type, F.lit(""))).isin("TAX_INVOICE", "FAKTUR_PAJAK")
    number = (field == "document_number") & ((F.contains(normal, F.lit("pajak")) & ~tax_document) | has(V.NOT_NUMBER_LABELS))
    return ~(number | ((field == "transaction_amount") & has(V.NOT_AMOUNT_LABELS)))


def amount_priority(label: Column) -> Column:
    """4 to 1: how surely a label names the final amount."""
    return let(F.coalesce(norm_label(label), F.lit("")), _priority_of)


def _priority_of(normal: Column) -> Column:
    has = lambda ws: reduce(lambda a, w: a | F.contains(normal, F.lit(w)), ws, F.lit(False))
    return F.coalesce(*[F.when(has(phrases), priority) for priority, phrases in V.AMOUNT_PRIORITIES], F.lit(1))


def evidence_label(quote: Column) -> Column:
    """What an evidence quote names: its label, else what stands before its first separator."""
    return F.coalesce(label_part(quote), F.get(F.split(quote, r"(?<!\d)[\s:=-]+(?!\d)", 2), 0))


def text_usable(text: Column) -> Column:
    """A text layer is usable: 40 characters and more, nearly all printable, over a third letters or digits, none unknown."""
    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", ""), _solid_usable)


def _solid_usable(solid: Column) -> Column:
    n = F.length(solid)
    printable = F.length(F.regexp_replace(solid, r"\p{C}", ""))
    letters = F.length(F.regexp_replace(solid, r"[^\p{L}\p{N}]", ""))
    return (n >= 40) & (printable >= 0.98 * n) & (letters >= 0.35 * n) & ~F.contains(solid, F.lit("�"))


def idempotency_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def mime_from_name(name: Column) -> Column:
    kinds = {"pdf": "application/pdf", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))), F.lit("application/octet-stream"))


def name_from_url(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"([^/]*)/*$", 1)


def normal_value(field: Column, value: Column) -> Column:
    """Values as they are compared: amounts as numbers, dates trimmed, the rest trimmed capitals."""
    bare = F.replace(F.trim(value), F.lit(","))
    amount = F.coalesce(bare.try_cast(MONEY).cast("string"), F.upper(bare))
    return F.when(field == "transaction_amount", amount).when(field == "transaction_date", F.trim(value)).otherwise(F.upper(F.trim(value)))

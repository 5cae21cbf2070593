"""Personal data replaced by keyed surrogates, in DataFrame expressions only.

Detected kinds: e-mail addresses, telephone numbers, IPv4 and IPv6 addresses, payment card numbers, US social security
numbers, IBANs, access keys, values of passwords and tokens, and names of persons (after a title, or a common given name
before a surname). A surrogate is of the same kind and format: separators, grouping, letter case, lengths, country
codes, top-level domains, card brands and check digits (Luhn, mod 97) hold; IPv6 surrogates are written in full. Values
that are symbols only get other symbols. Listed given names get listed given names of the same gender and script; others
get made-up ones with an ending of their gender, which the corpus' titles before the name decide by majority, and the
name's own ending where there is none. Surnames get made-up surnames of the same script.

A surrogate depends on a secret key and the normalised entity alone (and on the gender, which is one for the corpus), so
every mention of an entity gets the same one in whatever format it is written, in all documents (coreference).
Distinctness is checked over the whole corpus: where two entities of a kind would get one surrogate, or a surrogate is
itself an entity of the corpus, all but one draw again with the next attempt number until none collide. From attempt
``LONGER`` on the attempt number also adds characters to e-mail names, telephone and social security numbers and
secrets, and names grow from the second attempt, so no space of surrogates is ever exhausted by these. What still
collides at attempt ``ATTEMPTS`` gets 64 hex digits of its hash instead of its format. Entities that drew again, and given
names whose gender is not that of their ending, are kept in a table that is joined to their documents; all others
need no join. Listed given names are permuted, which cannot collide.

Null text stays null; text without an entity is returned as it is. Repeated rows are treated alike. Counts are per row.
Patterns have no unbounded groups, so very long hosts or texts are no deeper than short ones: of a host of more than 127
labels the first ones are taken.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spare

#: To be replaced by a secret of one's own.
KEY = "change-this-key"
#: Entities that drew again are broadcast up to this many, else joined by shuffle.
BROADCAST_ROWS = 100_000
#: Attempts from which surrogates get longer, and after which formats are given up.
LONGER, ATTEMPTS = 4, 24

# Common given names by gender and script, titles, and syllables for surnames.
GIVEN = {
    ("f", "latin"): "Anna Maria Emma Sophie Laura Julia Sarah Lisa Alice Clara Elena Lucia Carmen Isabel Claire Camille Chloe Manon Hannah Lena Katharina Susanne Monika Petra Emily Olivia Jessica Jennifer Elizabeth Margaret Patricia Linda Barbara Susan Karen Nancy Dorothy Helen Ruth Sharon".split(),
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth George Edward Brian Hans Peter Klaus Stefan Markus Juergen Pierre Jean Louis Antoine Nicolas Carlos Javier Miguel Alejandro Fernando Pablo Diego Luca Marco".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия Людмила Галина".split(),
    ("m", "cyrillic"): "Иван Александр Сергей Дмитрий Андрей Алексей Николай Владимир Михаил Павел Виктор Олег".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Βασιλική Σοφία Αγγελική Γεωργία Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Κώστας Γιάννης Νίκος Παναγιώτης Χρήστος Βασίλης".split(),
}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία"]
HERS, HIS = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"]
SYLLABLES = {
    "latin": "ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he hi ho ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi wa".split(),
    "cyrillic": "ба бе би бо бу ва ве ви во га го да де ди до ду жа за зе зи зо ка ке ки ко ку ла ле ли ло лу ма ме ми мо му на не ни но ну па пе пи по ра ре ри ро ру са се си со су та те ти то ту ха хо ша".split(),
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο ζα ζε ζι ζο θα θε θι θο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε φι φο χα χε χι χο βου γου δου κου".split(),
}

#: Endings of made-up given names by gender and script, of surnames, and which endings of real given names are feminine.
ENDINGS = {
    ("f", "latin"): "na la ra sa ta da lia mia".split(),
    ("m", "latin"): "n r s l t d k m".split(),
    ("f", "cyrillic"): "на ла ра са та да ля ня".split(),
    ("m", "cyrillic"): "н р с л т д к м".split(),
    ("f", "greek"): "να λα ρα σα τα νη λη ρη".split(),
    ("m", "greek"): "νος λος ρος σος τος κης νης ρης".split(),
    ("s", "latin"): ["", *"n r s l t k m".split()],
    ("s", "cyrillic"): ["", *"н р с л т к м".split()],
    ("s", "greek"): "ς ν νης λης ρης κης δης της".split(),
}
FEMININE = r"[aeiyаяαη]$"

_NAMES = sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n))
_LISTED = [n.lower() for n in _NAMES]
_CAPITAL = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_GROUP = "[0-9A-Fa-f]{1,4}"


def _ipv6() -> str:
    """Full and compressed addresses, both also with their last two groups as IPv4; not the bare '::'."""
    forms = [rf"(?:{_GROUP}:){{6}}{_DOTTED}", rf"(?:{_GROUP}:){{7}}{_GROUP}"]
    for n in range(8):
        left = rf"{_GROUP}(?::{_GROUP}){{{n - 1}}}" if n else ""
        if n < 6:
            forms.append(rf"{left}::(?:{_GROUP}:){{0,{5 - n}}}{_DOTTED}")
        right = rf"{_GROUP}(?::{_GROUP}){{0,{6 - n}}}" if n < 7 else ""
        forms.append(rf"{left}::(?:{right})?" if n else f"::{right}")
    return rf"(?<![0-9A-Za-z:])(?={_GROUP}:|::)(?:{'|'.join(forms)})(?![0-9A-Za-z:]|\.[0-9])"


PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API_KEY)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{8,128}",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": _ipv6(),
    "ipv4": rf"(?<![0-9A-Za-z.]){_DOTTED}(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "person": rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.? {_CAPITAL}(?: {_CAPITAL})?|(?:{'|'.join(_NAMES)}) {_CAPITAL})(?!\p{{L}})",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())


def _let(value: Column, body):
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fits(kind: str, c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"^(?:{PATTERNS[kind]})$"))


def kind_of(match: Column) -> Column:
    """The first kind, in the order of ``PATTERNS``, that a whole match is of."""
    out = F.when(F.contains(match, F.lit("@")) & _fits("email", match), "email")
    for kind in KINDS[1:]:
        out = out.when(_fits(kind, match), kind)
    return out.otherwise("secret")


_SECRET_HEAD = r"^\p{L}+[_-]?\p{L}*\s*[=:]\s*[\"']?"
_TITLE_HEAD = rf"^(?:(?:{'|'.join(TITLES)})\.? )?"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _eight_groups(c: Column) -> Column:
    """An IPv6 address as eight groups of four digits."""
    octet = lambda i: F.lower(F.lpad(F.conv(F.regexp_extract(c, r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)$", i), 10, 16), 2, "0"))
    plain = F.when(F.contains(c, F.lit(".")), F.concat(F.regexp_replace(c, r"[0-9.]+$", ""), octet(1), octet(2), F.lit(":"), octet(3), octet(4))).otherwise(c)
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    halves = lambda p: F.struct(groups(F.substring_index(p, "::", 1)).alias("l"), F.when(F.contains(p, F.lit("::")), groups(F.substring_index(p, "::", -1))).otherwise(F.array().cast("array<string>")).alias("r"))
    joined = lambda h: F.concat(h["l"], F.array_repeat(F.lit("0"), 8 - F.size(h["l"]) - F.size(h["r"])), h["r"])
    return F.array_join(F.transform(_let(_let(plain, halves), joined), lambda g: F.lpad(g, 4, "0")), ":")


def norms(kind: Column, match: Column) -> Column:
    """The entities of a match as structs (kind, norm, sex), normalised: names give one for each token, all else one. A token is a
    given name if it is listed or the first of two, else a surname. sex is 1 for a given name after a woman's title, -1 after a
    man's, and 0 otherwise."""
    one = F.when(kind == "email", F.lower(match)).when(kind == "phone", F.right(_digits(match), F.lit(10))).when(kind.isin("card", "ssn"), _digits(match))
    one = one.when(kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).when(kind == "ipv6", _let(F.lower(match), _eight_groups)).when(kind == "secret", F.regexp_replace(match, _SECRET_HEAD, "")).otherwise(match)
    entity = lambda k, n, s: F.struct(k.alias("kind"), n.alias("norm"), s.cast("int").alias("sex"))
    title = F.regexp_extract(match, rf"^({'|'.join(TITLES)})\.? ", 1)
    sex = F.when(title.isin(HERS), 1).when(title.isin(HIS), -1).otherwise(0)
    tokens = F.split(F.lower(F.regexp_replace(match, _TITLE_HEAD, "")), " ")
    given = lambda t, i: t.isin(_LISTED) | ((i == 0) & (F.size(tokens) > 1))
    names = F.transform(tokens, lambda t, i: entity(F.when(given(t, i), "given").otherwise("surname"), t, F.when(given(t, i), sex).otherwise(0)))
    return F.when(kind == "person", names).otherwise(F.array(entity(kind, one, F.lit(0))))


def _hash(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits, keyed twice."""
    message = F.concat_ws("\x1f", kind, norm, attempt.cast("string"))
    return F.sha2(F.concat(F.lit(key + "\x1e"), F.sha2(F.concat(F.lit(key + "\x1f"), message), 256)), 512)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _digit_at(h: Column, i: Column) -> Column:
    """Digit i (from 0) of a hash, from two hex digits."""
    return F.pmod(F.conv(F.substr(h, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(10)).cast("string")


def _letter_at(h: Column, i: Column, letters: str) -> Column:
    return F.substr(F.lit(letters), F.pmod(F.conv(F.substr(h, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(letters))) + 1, F.lit(1))


def _same_format(h: Column, c: Column, symbols: str = "") -> Column:
    """Digits for digits, small letters for small and capitals for capitals; all else stays, or becomes one of ``symbols`` if there
    is neither a letter nor a digit."""
    low, up = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    put = lambda x, i: F.when(F.regexp_like(x, F.lit("^[0-9]$")), _digit_at(h, i)).when(F.regexp_like(x, F.lit("^[a-z]$")), _letter_at(h, i, low)).when(F.regexp_like(x, F.lit("^[A-Z]$")), _letter_at(h, i, up)).otherwise(x)
    same = F.array_join(F.transform(_chars(c), put), "")
    if not symbols:
        return same
    return F.when(F.regexp_like(c, F.lit("[0-9A-Za-z]")), same).otherwise(F.array_join(F.transform(_chars(c), lambda x, i: _letter_at(h, i, symbols)), ""))


def _more_digits(h: Column, n: Column) -> Column:
    """``n`` digits from the end of a hash, none for 0."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: _digit_at(h, F.lit(62) - i)), "")).otherwise("")


def _all_digits(h: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _digit_at(h, i)), "")


def _luhn(body: Column) -> Column:
    """``body`` and its check digit."""
    back = F.reverse(_chars(body))
    value = lambda x, i: _let(x.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    total = F.aggregate(F.transform(back, value), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _iban(h: Column, norm: Column) -> Column:
    """Country, check digits by mod 97, and an account of the same format."""
    country, account = F.left(norm, F.lit(2)), _same_format(h, F.substr(norm, F.lit(5)))
    as_number = lambda c: F.transform(_chars(c), lambda x: F.when(F.regexp_like(x, F.lit("^[0-9]$")), x).otherwise((F.ascii(x) - 55).cast("string")))
    digits = lambda a: _chars(F.array_join(as_number(F.concat(a, country, F.lit("00"))), ""))
    return _let(account, lambda a: F.concat(country, F.lpad((98 - F.aggregate(digits(a), F.lit(0), lambda s, x: (s * 10 + x.cast("int")) % 97)).cast("string"), 2, "0"), a))


def _script(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(c, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _name(h: Column, norm: Column, ending: str, least: int, attempt: Column) -> Column:
    """``least`` syllables of the script of ``norm`` and one more for each attempt, with an ending of a gender or of surnames."""

    def made(script: str) -> Column:
        known, ends = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[ending, script]))
        number = lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        pick = lambda a, i, n: F.element_at(a, F.pmod(number(i), F.lit(n)) + 1)
        body = F.transform(F.sequence(F.lit(0), F.lit(least - 1) + attempt), lambda i: pick(known, i, len(SYLLABLES[script])))
        return F.concat(F.array_join(body, ""), pick(ends, F.lit(31), len(ENDINGS[ending, script])))

    script = _script(norm)
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def feminine(norm: Column) -> Column:
    """Whether a given name's ending is a woman's."""
    return F.regexp_like(norm, F.lit(FEMININE))


def _given_map(key: str) -> dict[str, str]:
    """Each given name of the lists to the next of its gender and script in an order that depends on the key."""
    out = {}
    for group, names in GIVEN.items():
        order = sorted((n.lower() for n in names), key=lambda n: hashlib.sha256(f"{key}\x1f{group}\x1f{n}".encode()).hexdigest())
        out |= dict(zip(order, order[1:] + order[:1]))
    return out


def surrogate(key: str, kind: Column, norm: Column, code: Column) -> Column:
    """The normalised surrogate of a normalised entity. ``code`` is twice the attempt, and one more for a given name whose gender is
    not that of its ending."""
    known = F.create_map(*[F.lit(x) for pair in _given_map(key).items() for x in pair])
    octets = lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.when(i == 0, 223).otherwise(254)) + 1).cast("string")), ".")
    domain = F.substring_index(norm, "@", -1)
    site = lambda d: F.concat(_same_format(_hash(key, F.lit("domain"), d, F.lit(0)), F.regexp_extract(d, r"^(.*)\.[^.]*$", 1)), F.lit("."), F.substring_index(d, ".", -1))
    attempt = F.floor(code / 2).cast("int")
    longer = F.greatest(attempt - (LONGER - 1), F.lit(0))
    woman = feminine(norm) != (code % 2 == 1)

    def made(h: Column) -> Column:
        first = F.when(F.length(norm) == 10, (F.pmod(_digit_at(h, F.lit(60)).cast("int"), F.lit(8)) + 2).cast("string")).otherwise(_digit_at(h, F.lit(60)))
        more = _more_digits(h, longer)
        return (
            F.when(attempt >= ATTEMPTS, F.left(h, F.lit(64)))
            .when(kind == "email", F.concat(_same_format(h, F.substring_index(norm, "@", 1), "_%+-"), more, F.lit("@"), site(domain)))
            .when(kind == "phone", F.concat(first, F.when(F.length(norm) > 1, _all_digits(h, F.length(norm) - 1)).otherwise(""), more))
            .when(kind == "ipv4", octets(h))
            .when(kind == "ipv6", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(h, i * 4 + 1, F.lit(4))), ":"))
            .when(kind == "card", _luhn(F.concat(F.left(norm, F.lit(1)), _all_digits(h, F.length(norm) - 2))))
            .when(kind == "ssn", F.concat(_all_digits(h, F.lit(9)), more))
            .when(kind == "iban", _iban(h, norm))
            .when(kind == "access", F.concat(F.left(norm, F.lit(4)), _same_format(h, F.substr(norm, F.lit(5)))))
            .when((kind == "secret") & F.regexp_like(norm, F.lit("^[0-9a-f]+$")), F.concat(F.left(h, F.length(norm)), more))
            .when(kind == "secret", F.concat(_same_format(h, norm, "+/_.~!@#$%^&*-"), more))
            .when(kind == "given", F.coalesce(F.element_at(known, norm), F.when(woman, _name(h, norm, "f", 3, attempt)).otherwise(_name(h, norm, "m", 3, attempt))))
            .when(kind == "surname", _name(h, norm, "s", 4, attempt))
            .otherwise(_same_format(h, norm))
        )

    return _let(_hash(key, kind, norm, attempt), made)


def _redigit(match: Column, digits: Column) -> Column:
    """``match`` with its last digits replaced by ``digits`` in order; any digits before them stay, and what ``digits`` has more than
    the match is put behind it."""
    all_ = F.length(_digits(match))
    skip = F.greatest(all_ - F.length(digits), F.lit(0))
    nth = lambda i: F.length(_digits(F.substr(match, F.lit(1), i + 1)))
    put = lambda x, i: F.when(F.regexp_like(x, F.lit("^[0-9]$")) & (nth(i) > skip), F.substr(digits, nth(i) - skip, F.lit(1))).otherwise(x)
    return F.concat(F.array_join(F.transform(_chars(match), put), ""), F.substr(digits, all_ + 1))


def _cased(like: Column, c: Column) -> Column:
    """``c`` in capitals, or with capitals first, as ``like`` has them."""
    title = F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    return F.when(like == F.lower(like), c).when((F.length(like) > 1) & (like == F.upper(like)), F.upper(c)).otherwise(title)


def _recased(like: Column, c: Column) -> Column:
    """``c`` with capitals where ``like``, of the same length, has them."""
    return F.array_join(F.zip_with(_chars(like), _chars(c), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b)), "")


def replacement(key: str, match: Column, code) -> Column:
    """What stands for a match; ``code`` gives the code of (kind, norm)."""

    def of(kind: Column) -> Column:
        def one(ns: Column) -> Column:
            made = lambda n: surrogate(key, n["kind"], n["norm"], code(n["kind"], n["norm"]))
            plain = code(F.element_at(ns, 1)["kind"], F.element_at(ns, 1)["norm"]) < 2 * ATTEMPTS

            def put(ms: Column) -> Column:
                first = F.element_at(ms, 1)
                spaced = F.array_join(F.transform(_chars(match), lambda x, i: F.when(x == " ", x).otherwise(F.substr(first, F.length(F.replace(F.substr(match, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
                tokens = F.split(F.regexp_replace(match, _TITLE_HEAD, ""), " ")
                return (
                    F.when(kind == "person", F.concat(F.regexp_extract(match, _TITLE_HEAD, 0), F.array_join(F.zip_with(tokens, ms, _cased), " ")))
                    .when(kind == "secret", F.concat(F.regexp_extract(match, _SECRET_HEAD, 0), first))
                    .when(plain & (kind == "email"), _recased(match, first))
                    .when(plain & kind.isin("phone", "card", "ssn"), _redigit(match, first))
                    .when(plain & (kind == "iban"), spaced)
                    .otherwise(first)
                )

            return _let(F.transform(ns, made), put)

        return _let(norms(kind, match), one)

    return _let(kind_of(match), of)


def _may_have(text: Column) -> Column:
    """A necessary condition: every match has a digit, @, = or :, or the head of an access key, or a space between a letter and a
    name's capital, or a title with its dot."""
    out = F.regexp_like(text, F.lit(r"[0-9@=:]|\p{L} \p{Lu}"))
    for part in ("AKIA", "ASIA", *(f"{t}. " for t in TITLES)):
        out = out | F.contains(text, F.lit(part))
    return out


def matches(text: Column) -> Column:
    return F.when(_may_have(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


_MARK = "\x01"


def pieces(text: Column) -> Column:
    """``text`` as an array of what stands between matches, and the matches, in turn. The patterns run once, with a mark
    put at either end of a match, and twice on a text that has the mark's character itself."""
    once = F.split(F.regexp_replace(text, F.lit(f"({ANY})"), F.lit(f"{_MARK}$1{_MARK}")), _MARK, -1)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    twice = F.flatten(F.zip_with(F.split(text, ANY, -1), found, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(~_may_have(text), F.array(text)).when(F.contains(text, F.lit(_MARK)), twice).otherwise(once)


def mentions(docs: DataFrame, text: str = "text") -> DataFrame:
    """(content, kind, norm, sex) of the entities of every different text; content is a hash of the text."""
    found = docs.select(F.xxhash64(F.col(text)).alias("content"), F.explode(matches(F.coalesce(F.col(text), F.lit("")))).alias("m"))
    each = found.select("content", F.explode(norms(kind_of(F.col("m")), F.col("m"))).alias("n"))
    return each.select("content", "n.kind", "n.norm", "n.sex").distinct()


def entities(mentioned: DataFrame) -> DataFrame:
    """(kind, norm, sex) of every distinct entity; sex by the majority of the texts that tell it."""
    return mentioned.groupBy("kind", "norm").agg(F.signum(F.sum("sex")).cast("int").alias("sex"))


def drawn_again(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, code) of the entities whose code is not 0: those whose first surrogate collides, and given names whose
    gender is not that of their ending. ``found`` has kind and norm, each pair once, and sex."""
    real = found.select("kind", F.col("norm").alias("s"), F.lit(True).alias("real"))
    found = found.where(~((F.col("kind") == "given") & F.col("norm").isin(_LISTED)))
    turned = (F.col("kind") == "given") & (F.col("sex") != 0) & ((F.col("sex") > 0) != feminine(F.col("norm")))
    found = cut(found.select("kind", "norm", turned.cast("int").alias("turn"), F.lit(0).alias("attempt")))
    drawn = lambda rows: rows.select("*", surrogate(key, F.col("kind"), F.col("norm"), F.col("turn") + 2 * F.col("attempt")).alias("s"))
    taken = cut(drawn(found))
    for _ in range(ATTEMPTS):
        winners = taken.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("w"), F.count("*").alias("n")).where("n > 1")
        marked = taken.join(winners, ["kind", "s"], "left").join(real, ["kind", "s"], "left")
        beaten = (F.col("w.norm") != F.col("norm")) | (F.col("w.attempt") != F.col("attempt"))
        lost = cut(marked.where(F.col("real").isNotNull() | (F.col("n").isNotNull() & beaten)).select("kind", "norm", "turn", (F.col("attempt") + 1).alias("attempt")))
        if lost.isEmpty():
            break
        taken = cut(taken.join(lost, ["kind", "norm"], "left_anti").unionByName(drawn(lost)))
    return taken.select("kind", "norm", (2 * F.col("attempt") + F.col("turn")).alias("code")).where("code > 0")


def replace(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, and with the number of replaced matches in a column ``count`` if one is named."""
    mentioned = cut(mentions(docs, text))
    again = cut(drawn_again(entities(mentioned), key))
    n_again, names = again.count(), docs.columns
    codes, content, split = (spare(names, x) for x in ("codes", "content", "pieces"))
    if n_again:
        small = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
        entry = F.struct(F.concat_ws("\x1f", "kind", "norm"), F.col("code"))
        found = cut(mentioned.join(small, ["kind", "norm"]).groupBy(F.col("content").alias(content)).agg(F.map_from_entries(F.collect_set(entry)).alias(codes)))
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        rows = docs.select("*", F.xxhash64(F.col(text)).alias(content)).join(found, content, "left")
        code = lambda kind, norm: F.coalesce(F.element_at(F.col(codes), F.concat_ws("\x1f", kind, norm)), F.lit(0))
    else:
        rows, code = docs, lambda kind, norm: F.lit(0)
    met = rows.select("*", pieces(F.col(text)).alias(split))
    put = F.transform(split, lambda x, i: F.when(i % 2 == 1, replacement(key, x, code)).otherwise(x))
    new = F.when(F.size(split) > 1, F.array_join(put, "")).otherwise(F.col(text))
    replaced = F.when(F.col(text).isNull(), 0).otherwise(F.floor(F.size(split) / 2)).cast("int")
    out = [new.alias(text) if c == text else met[c] for c in names if c != count]
    return met.select(*out, *([replaced.alias(count)] if count else []))

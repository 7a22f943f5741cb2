"""Where personal data may stand in a text: the base rules, wider candidates, and what labelers say of each.

Everything here is linear in the text. Spans are (kind, start, end) in code points, end exclusive.
"""

from __future__ import annotations

import re
import zlib

EMAIL, IP, CARD, PHONE = range(4)
KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Digits with what may stand between them; wider numbers are looked for in these stretches.
STRETCH = re.compile(r"[0-9](?:[] ().+/_[-]{0,3}[0-9])*")
WIDE_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ ._/-])[0-9]{6}\2[0-9]{4,5})(?![0-9])")
WIDE_PHONE = re.compile(
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?:\+|(?<![0-9])00)[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?![0-9])(?:[ .-][0-9]{2,4}(?![0-9])){1,4}"
    r"|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
)
WIDE_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}(?![0-9])){3}")
#: An at sign that is spelled, bracketed or apart, and the host that follows it.
AT = re.compile(r" ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| @ ?|@ | ?＠ ?| (?:at|AT) ")
HOST = re.compile(r"[A-Za-z0-9-]+(?:(?P<dot> ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| (?:dot|DOT) |\.|．)[A-Za-z0-9-]+)+")
SPELLED = re.compile(r"dot|DOT")
#: Without one of these a text has no match of AT that counts.
AT_SIGNS = ("@", "＠", " dot ", " DOT ", "at]", "at)", "at}", "at>", "AT]", "AT)", "AT}", "AT>", "at ]", "at )", "at }", "at >", "AT ]", "AT )", "AT }", "AT >")

# Gazetteers.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz io ai app dev co me tv us uk ca au nz ie de at ch fr be nl lu es pt it gr se no fi dk is pl cz sk hu ro bg hr si rs ua ru tr il ae sa eg za ng ke in pk bd lk cn hk tw jp kr sg my th vn id ph br ar cl pe ve mx cr pa ec uy bo eu".split()
)
FILE_ENDINGS = frozenset("py js ts css html htm png jpg jpeg gif svg pdf txt csv json xml zip gz tar exe dll java cpp rs go md".split())
CALLING_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 234 254 351 352 353 354 358 359 370 371 372 380 385 386 420 421 506 507 591 593 595 598 852 880 886 961 962 965 966 968 971 972 973 974".split()
)
POSITIVE = (
    frozenset("email e-mail mail mailto contact contacto contactar correo courriel kontakt schreiben write reach address adresse".split()),
    frozenset("ip ipv4 host server serveur servidor address adresse dirección client login logged from gateway ping dns".split()),
    frozenset("card cards visa mastercard amex credit debit karte kreditkarte carte tarjeta payment pay paid zahlung pago cc pan".split()),
    frozenset("phone tel telephone telefon teléfono téléphone call cell mobile móvil handy fax sms whatsapp contact number nummer numéro".split()),
)
NEGATIVE = (
    frozenset("pip npm git import class def decorator".split()),
    frozenset("version ver v release build section sect chapter figure fig table firmware".split()),
    frozenset("isbn ean order invoice ref reference tracking serial sku imei id account timestamp".split()),
    frozenset("isbn ean order invoice ref reference tracking serial sku version price date lot".split()),
)
#: Votes of the labelers on a candidate: 1 for, -1 against, 0 abstains.
LABELERS = ("format", "checksum", "gazetteer", "context_for", "context_against", "bounds", "spelling", "variety")
BUCKETS = 128
N_FEATURES = 3 * len(LABELERS) + 32 + 32 + 3 * BUCKETS + 2 * 6 + 1

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * c - 9 * (c > 4) for c in back[1::2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[Span]:
    """Each at sign has one run of local characters before it; matches don't overlap and the leftmost go first."""
    out, free, q = [], 0, text.find("@")
    while q >= 0:
        start = free + len(text[free:q].rstrip(LOCAL))
        found = DOMAIN.match(text, q + 1) if start < q else None
        if found:
            out.append((EMAIL, start, found.end()))
        free = found.end() if found else q + 1
        q = text.find("@", free)
    return out


def addresses(text: str) -> list[Span]:
    """A chain of dotted numbers gives one match for each four of them."""
    out = []
    for chain in DOTTED.finditer(text):
        numbers, at = chain.group().split("."), chain.start()
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                out.append((IP, at, at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[Span]:
    """The spans that the contract's rules give, by kind and start."""
    out = emails(text) if "@" in text else []
    out += addresses(text)
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out += [(PHONE, m.start(), m.end()) for m in PLUS.finditer(text) if 9 <= len(digits_of(m.group())) <= 15]
    return out


def wide_spans(text: str) -> list[Span]:
    """Candidates beside the base rules: numbers inside longer stretches, other separators, spelled and bracketed addresses."""
    out = []
    for m in STRETCH.finditer(text):
        a, b = m.span()
        if b - a < 7:
            continue
        a -= len(lead := text[max(0, a - 2) : a]) - len(lead.rstrip("+("))
        out += [(CARD, *x.span()) for x in WIDE_CARD.finditer(text, a, b)]
        out += [(PHONE, *x.span()) for x in WIDE_PHONE.finditer(text, a, b)]
        out += [(IP, *x.span()) for x in WIDE_IP.finditer(text, a, b)]
    if not any(sign in text for sign in AT_SIGNS):
        return out
    free = 0
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        if not host or m.group().strip() in ("at", "AT") and not SPELLED.search(host.group()):  # "look at example.com"
            continue
        start = free + len(text[free : m.start()].rstrip(LOCAL))
        if start < m.start():
            out.append((EMAIL, start, host.end()))
        free = m.end()
    return out


WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def char_class(c: str) -> int:
    return 0 if not c else 1 if c == "\n" else 2 if c.isspace() else 3 if c.isalpha() else 4 if c.isdigit() else 5


def sign(yes: bool) -> int:
    return 1 if yes else -1


def votes(kind: int, text: str, start: int, end: int, before: list[str], after: list[str]) -> list[int]:
    """What each labeler says, in the order of LABELERS."""
    span = text[start:end]
    d = digits_of(span)
    left, right = text[start - 1 : start], text[end : end + 1]
    near = set(before[-6:]) | set(after[:3])
    context = [1 if near & POSITIVE[kind] else 0, -1 if near & NEGATIVE[kind] else 0]
    glued = left.isalnum() or right.isalnum() or left in ('"', "=", "_") or right in ('"', "_") or (right in (".", "-") and text[end + 1 : end + 2].isdigit())
    variety = 0
    if kind == EMAIL:
        at = AT.search(span)
        local, host = (span[: at.start()], span[at.end() :]) if at else span.split("@", 1)
        last = re.split(r"[^A-Za-z0-9-]+", host)[-1].lower()
        form = sign(at is None and len(local) <= 64)
        check = sign(not local.startswith(".") and not local.endswith(".") and ".." not in local and not host.startswith("-"))
        listed = 1 if last in TOP_LEVEL else -1 if last in FILE_ENDINGS or last.isdigit() else 0
        spelled = 0 if at is None else sign(at.group().strip() not in ("at", "AT", "@") or bool(set(local) & set("._0123456789")))
    elif kind == IP:
        four = [int(x) for x in re.findall(r"[0-9]+", span)[:4]]
        form = sign("[" not in span and "(" not in span and all(str(x) in span for x in four))
        check = sign(all(x <= 255 for x in four) and left != "." and not (right == "." and text[end + 1 : end + 2].isdigit()))
        listed = sign(0 < four[0] < 240 and four[0] != 127)
        spelled = 0
        variety = -1 if max(four) < 10 else 0
    else:
        groups = [len(g) for g in re.findall(r"[0-9]+", span)]
        variety = -1 if len(set(d)) <= 2 or d in "01234567890123456789" else 0
        if kind == CARD:
            form = sign(len(groups) == 1 or groups[:3] == [4, 4, 4] or groups[:2] == [4, 6])
            check = sign(luhn(d))
            listed = sign(
                d[0] == "4" and len(d) in (13, 16, 19) or (51 <= int(d[:2]) <= 55 or 2221 <= int(d[:4]) <= 2720) and len(d) == 16 or d[:2] in ("34", "37") and len(d) == 15 or (d[:4] == "6011" or d[:2] in ("65", "35", "62")) and 16 <= len(d) <= 19 or d[:2] in ("30", "36", "38") and len(d) == 14
            )
            spelled = -1 if set(span) & set("./_") else 0
        else:
            form = sign(span[0] == "+" or span[0] == "(" or groups == [3, 3, 4])
            check = sign(9 <= len(d) <= 15)
            code = d[2:] if span[:2] == "00" else d
            listed = (1 if any(code[:k] in CALLING_CODES for k in (1, 2, 3)) else -1) if span[0] == "+" or span[:2] == "00" else 0
            spelled = 1 if set(span) & set(" ().-") else 0
    return [form, check, listed, *context, sign(not glued), spelled, variety]


def features(kind: int, text: str, start: int, end: int, said: list[int], before: list[str], after: list[str]) -> list[int]:
    """Places of the ones in a candidate's feature vector."""
    span = text[start:end]
    shape = re.sub(r"[0-9]", "9", re.sub(r"[^\W\d_]+", "a", span))
    out = [3 * i + v + 1 for i, v in enumerate(said)]
    at = 3 * len(said)
    out.append(at + min(31, end - start))
    out.append(at + 32 + min(31, len(digits_of(span))))
    at += 64
    for k, word in enumerate((before[-1] if before else "", after[0] if after else "", shape)):
        out.append(at + k * BUCKETS + zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS)
    at += 3 * BUCKETS
    out.append(at + char_class(text[start - 1 : start] if start else ""))
    out.append(at + 6 + char_class(text[end : end + 1]))
    return [*out, at + 12]


def candidates(text: str) -> tuple[list[Span], list[tuple[int, int, int, bool, list[int], list[int]]]]:
    """The base spans, and every candidate (kind, start, end, in the base, votes, features), base ones among them."""
    base = base_spans(text)
    known = set(base)
    out = []
    for kind, start, end in [*base, *sorted(set(wide_spans(text)) - known)]:
        before = [w.lower() for w in WORD.findall(text, max(0, start - 60), start)]
        after = [w.lower() for w in WORD.findall(text, end, end + 40)]
        said = votes(kind, text, start, end, before, after)
        out.append((kind, start, end, (kind, start, end) in known, said, features(kind, text, start, end, said, before, after)))
    return base, out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))

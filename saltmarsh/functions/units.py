"""A grammar for numbers and unit expressions.

A unit is (scale, offset, dimension): value_SI = value * scale + offset, the dimension a vector of exponents
of mass, length, time, temperature and current. Texts that are no unit parse to None.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

Dimension = tuple[int, int, int, int, int]


class Unit(NamedTuple):
    scale: float
    offset: float
    dim: Dimension


#: SI scale and exponents (kg, m, s, K, A) of each unit symbol.
SYMBOLS: dict[str, tuple[float, Dimension]] = {
    "g": (1e-3, (1, 0, 0, 0, 0)), "gm": (1e-3, (1, 0, 0, 0, 0)), "gram": (1e-3, (1, 0, 0, 0, 0)),
    "lb": (0.45359237, (1, 0, 0, 0, 0)), "lbm": (0.45359237, (1, 0, 0, 0, 0)),
    "m": (1.0, (0, 1, 0, 0, 0)), "metre": (1.0, (0, 1, 0, 0, 0)), "meter": (1.0, (0, 1, 0, 0, 0)),
    "ft": (0.3048, (0, 1, 0, 0, 0)), "in": (0.0254, (0, 1, 0, 0, 0)), "inch": (0.0254, (0, 1, 0, 0, 0)),
    "L": (1e-3, (0, 3, 0, 0, 0)), "l": (1e-3, (0, 3, 0, 0, 0)), "litre": (1e-3, (0, 3, 0, 0, 0)), "liter": (1e-3, (0, 3, 0, 0, 0)),
    "cc": (1e-6, (0, 3, 0, 0, 0)),
    "s": (1.0, (0, 0, 1, 0, 0)), "sec": (1.0, (0, 0, 1, 0, 0)), "second": (1.0, (0, 0, 1, 0, 0)),
    "min": (60.0, (0, 0, 1, 0, 0)), "h": (3600.0, (0, 0, 1, 0, 0)), "hr": (3600.0, (0, 0, 1, 0, 0)),
    "K": (1.0, (0, 0, 0, 1, 0)), "kelvin": (1.0, (0, 0, 0, 1, 0)),
    "N": (1.0, (1, 1, -2, 0, 0)), "newton": (1.0, (1, 1, -2, 0, 0)), "dyn": (1e-5, (1, 1, -2, 0, 0)), "dyne": (1e-5, (1, 1, -2, 0, 0)),
    "lbf": (4.4482216152605, (1, 1, -2, 0, 0)),
    "J": (1.0, (1, 2, -2, 0, 0)), "joule": (1.0, (1, 2, -2, 0, 0)), "erg": (1e-7, (1, 2, -2, 0, 0)),
    "cal": (4.184, (1, 2, -2, 0, 0)), "calorie": (4.184, (1, 2, -2, 0, 0)), "Btu": (1055.05585262, (1, 2, -2, 0, 0)), "BTU": (1055.05585262, (1, 2, -2, 0, 0)),
    "W": (1.0, (1, 2, -3, 0, 0)), "watt": (1.0, (1, 2, -3, 0, 0)),
    "Pa": (1.0, (1, -1, -2, 0, 0)), "pascal": (1.0, (1, -1, -2, 0, 0)), "bar": (1e5, (1, -1, -2, 0, 0)),
    "atm": (101325.0, (1, -1, -2, 0, 0)), "torr": (101325.0 / 760, (1, -1, -2, 0, 0)), "Torr": (101325.0 / 760, (1, -1, -2, 0, 0)),
    "mmHg": (101325.0 / 760, (1, -1, -2, 0, 0)), "psi": (6894.757293168361, (1, -1, -2, 0, 0)), "psia": (6894.757293168361, (1, -1, -2, 0, 0)),
    "P": (0.1, (1, -1, -1, 0, 0)), "poise": (0.1, (1, -1, -1, 0, 0)),
    "S": (1.0, (-1, -2, 3, 0, 2)), "siemens": (1.0, (-1, -2, 3, 0, 2)), "mho": (1.0, (-1, -2, 3, 0, 2)),
    "ohm": (1.0, (1, 2, -3, 0, -2)), "Ω": (1.0, (1, 2, -3, 0, -2)), "A": (1.0, (0, 0, 0, 0, 1)), "V": (1.0, (1, 2, -3, 0, -1)),
}
#: Temperature names with scale and offset to kelvin; the offset holds only where the name stands alone.
DEGREES: dict[str, tuple[float, float]] = {
    "°C": (1.0, 273.15), "C": (1.0, 273.15), "degC": (1.0, 273.15), "celsius": (1.0, 273.15), "Celsius": (1.0, 273.15), "centigrade": (1.0, 273.15),
    "°F": (5 / 9, 459.67 * 5 / 9), "F": (5 / 9, 459.67 * 5 / 9), "degF": (5 / 9, 459.67 * 5 / 9), "fahrenheit": (5 / 9, 459.67 * 5 / 9), "Fahrenheit": (5 / 9, 459.67 * 5 / 9),
    "°K": (1.0, 0.0), "degK": (1.0, 0.0), "°R": (5 / 9, 0.0), "degR": (5 / 9, 0.0),
}
#: Decimal prefixes.
PREFIXES: dict[str, float] = {
    "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "μ": 1e-6, "n": 1e-9,
    "mega": 1e6, "kilo": 1e3, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6,
}

NONE: Dimension = (0, 0, 0, 0, 0)
_POWER = re.compile(r"\s*(?:[x×*]\s*)?(?:10\s*(?:\^|\*\*)?\s*\(?([+-]?\d+)\)?|(\d+(?:\.\d+)?)[eE]([+-]?\d+))(?=$|[\s*·.x×]|[^\W\d])\s*[*·×]?\s*")
_TOKEN = re.compile(r"\s*(?:(°\s?[CFKR]|[^\W\d_]+)|(?:\^|\*\*)?(?:\(([+-]?\d+)\)|([+-]?\d+))|([/()*.·-]))")
_WORDS = (
    (re.compile(r"\b(?:cubic|cu\.?)\s+([A-Za-z]+)"), r"\1^3"),
    (re.compile(r"\b(?:square|sq\.?)\s+([A-Za-z]+)"), r"\1^2"),
    (re.compile(r"\bdeg(?:rees?)?\.?\s+([CFKR])\b"), r"deg\1"),
    (re.compile(r"\bmm\s+Hg\b"), "mmHg"),
    (re.compile(r"\bper\b"), "/"),
    (re.compile(r"\blb\s*/\s*(in\^?2|inch\^?2)\b"), r"lbf/\1"),
)


def _add(a: Dimension, b: Dimension, n: int) -> Dimension:
    return tuple(x + n * y for x, y in zip(a, b))  # type: ignore[return-value]


@lru_cache(4096)
def _symbol(name: str) -> Unit | None:
    """A symbol, a prefixed symbol, or two symbols written together."""
    name = name.replace("° ", "°")
    if name in SYMBOLS:
        return Unit(SYMBOLS[name][0], 0.0, SYMBOLS[name][1])
    if name in DEGREES:
        return Unit(*DEGREES[name], (0, 0, 0, 1, 0))
    if name.endswith("s") and len(name) > 4 and name[:-1] in SYMBOLS:
        return Unit(SYMBOLS[name[:-1]][0], 0.0, SYMBOLS[name[:-1]][1])
    for k in (1, 4, 5):
        if name[:k] in PREFIXES and name[k:] in SYMBOLS:
            s, d = SYMBOLS[name[k:]]
            return Unit(PREFIXES[name[:k]] * s, 0.0, d)
    for k in range(len(name) - 1, 0, -1):
        a, b = name[:k], name[k:]
        if len(name) <= 5 and b in SYMBOLS and (x := _symbol(a)) and x.offset == 0:
            return Unit(x.scale * SYMBOLS[b][0], 0.0, _add(x.dim, SYMBOLS[b][1], 1))
    return None


@lru_cache(65536)
def parse_unit(text: str | None) -> Unit | None:
    """The unit a text states, None where it states none (null, blank, percent, words that are no unit)."""
    if not text:
        return None
    t = unicodedata.normalize("NFKC", text).replace("−", "-").replace("‐", "-").replace("–", "-").replace("∙", "·").strip()
    factor = 1.0
    if (m := _POWER.match(t)) and m.end() < len(t):
        power = int(m[1] or m[3])
        if abs(power) > 30:
            return None
        factor = (float(m[2]) if m[2] else 1.0) * 10.0**power
        t = t[m.end():]
    for pattern, by in _WORDS:
        t = pattern.sub(by, t)
    tokens: list[tuple[str, str]] = []
    at = 0
    t = t.strip()
    while at < len(t):
        m = _TOKEN.match(t, at)
        if not m or m.end() == at:
            return None
        if m[1]:
            tokens.append(("name", m[1]))
        elif m[2] or m[3]:
            tokens.append(("power", m[2] or m[3]))
        else:
            tokens.append(("op", m[4]))
        at = m.end()
    if not tokens or tokens[0][0] == "power":
        return None
    pos = 0
    alone: list[float] = []

    def group(depth: int) -> tuple[float, Dimension] | None:
        nonlocal pos
        scale, dim, sign, any_ = 1.0, NONE, 1, False
        while pos < len(tokens):
            kind, v = tokens[pos]
            if kind == "op" and v == ")":
                if depth == 0:
                    return None
                break
            if kind == "op" and v == "/":
                sign, pos = -1, pos + 1
                continue
            if kind == "op" and v in "*.·-":
                pos += 1
                continue
            if kind == "op":  # an opening bracket
                pos += 1
                inner = group(depth + 1)
                if inner is None or pos >= len(tokens):
                    return None
                pos += 1
                s, d, off = *inner, 0.0
            elif kind == "name":
                pos += 1
                u = _symbol(v)
                if u is None:
                    return None
                s, d, off = u.scale, u.dim, u.offset
            else:
                return None
            n = 1
            if pos < len(tokens) and tokens[pos][0] == "power":
                n = int(tokens[pos][1])
                pos += 1
            if not 0 < abs(n) <= 9:
                return None
            n *= sign if n > 0 or sign > 0 else 1
            scale, dim, any_ = scale * s**n, _add(dim, d, n), True
            alone.append(off)
        return (scale, dim) if any_ else None

    got = group(0)
    if got is None or pos < len(tokens) or abs(got[0]) == 0:
        return None
    offset = alone[0] if len(alone) == 1 and got[1] == (0, 0, 0, 1, 0) else 0.0
    return Unit(got[0] * factor, offset, got[1])


_NUMBER = r"[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][+-]?\d+)?"
_STARTS = re.compile(rf"(?<![\w.,]){_NUMBER}(?![\d.,]*\d)\s*|\b(?:in|as)\s+")


_WORD = re.compile(r"\s*(\S+)")
_NAMES = re.compile(r"°\s?[CFKR]|[^\W\d_]+")
#: Words that a unit expression may hold besides symbols (fixed values).
_LINKS = {"per", "cubic", "cu", "square", "sq", "deg", "degree", "degrees", "Hg", "x"}


def _run(text: str, at: int) -> list[int]:
    """Ends of the words from `at` on that may be parts of one unit expression, which ends with the first that can't be."""
    ends = []
    while m := _WORD.match(text, at):
        word = unicodedata.normalize("NFKC", m[1])
        bare = word.rstrip(".,;:)")
        if not all(n in _LINKS or _symbol(n) or _symbol(n.rstrip("s")) for n in _NAMES.findall(bare)):
            break
        ends.append(m.end())
        at = m.end()
        if word[-1] in ",;:":
            break
    return ends


@lru_cache(65536)
def find_unit(text: str | None, dim: Dimension) -> Unit | None:
    """The first longest unit expression after a number or after `in`/`as` in running text; one of dimension dim is preferred."""
    if not text:
        return None
    other = None
    for m in _STARTS.finditer(text):
        for end in reversed(_run(text, m.end())):
            part = text[m.end():end].strip().rstrip(",;:")
            for cand in (part, part.rstrip(".")):
                u = parse_unit(cand) if cand else None
                if u and u.dim == dim:
                    return u
                other = other or (u if u and u.dim != NONE else None)
    return other


_TEMPERATURE = re.compile(r"[;,]?\s*\b[Tt](?:emperature|emp\.?)?\s*(?:in\s+|/\s*|\[\s*|\(\s*)((?:deg(?:rees?)?\.?\s*|°\s*)?[CFK]|celsius|fahrenheit|kelvin)\b\]?\)?\s*$")
_FORM = re.compile(r"^\s*[A-Za-z][A-Za-z0-9]*\.?\s*")
_LEAD = re.compile(r"^(?:[;,:/]\s*)?(?:values?\s+)?(?:in\s+|as\s+)?\s*")


@lru_cache(65536)
def parse_form(text: str | None) -> tuple[str, str | None, str | None]:
    """A form text as (form, unit text or None, temperature name or None)."""
    if not text:
        return "", None, None
    temp = None
    if m := _TEMPERATURE.search(text):
        temp, text = re.sub(r"\s", "", m[1]), text[: m.start()]
    m = _FORM.match(text)
    form, rest = (m[0].strip(), text[m.end():]) if m else ("", text)
    rest = _LEAD.sub("", rest.strip()).strip()
    if rest[:1] in "([" and rest[-1:] in ")]" and rest:
        rest = rest[1:-1].strip()
    return form, rest or None, temp

"""Character references in HTML text and in attribute values.

Text and attributes follow different rules: in text a name counts as a whole
(``&copy2`` stays), in attributes old names also count as a prefix of what
follows (``&copy2`` is ``©2``). Both decode in one pass, so ``&amp;lt;`` gives
``&lt;``. The name table comes from the Python standard library.
"""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from hailbook.functions.text import StrCol, let, text_or_empty

REPLACEMENT = "\ufffd"

# Code points 0x80-0x9f mean windows-1252 characters.
_C1 = [bytes([n]) for n in range(0x80, 0xA0)]
_C1_PAIRS = [
    (b.decode("latin-1"), b.decode("cp1252", "ignore"))
    for b in _C1
    if b.decode("cp1252", "ignore")
]
C1_FROM = "".join(a for a, _ in _C1_PAIRS)
C1_TO = "".join(b for _, b in _C1_PAIRS)


GROUPS = 256


@cache
def _table() -> str:
    """All names and their characters, in groups by the first two letters.

    One string literal, split once when the plan is made: a name is looked for
    in a group of some 100 characters, whether it is known or not.
    """
    groups = ["\x02"] * GROUPS
    for name, char in {name.rstrip(";"): char for name, char in html5.items()}.items():
        groups[(ord(name[0]) + 7 * ord(name[1])) % GROUPS] += f"{name}\x03{char}\x02"
    return "\x04".join(groups)


@cache
def _old_names() -> str:
    """Names that are also valid without a semicolon, longest first."""
    names = [name for name in html5 if not name.endswith(";")]
    return "|".join(sorted(names, key=lambda n: (-len(n), n)))


# The rules are SQL lambdas: nested as they are, they are short to write and
# quick to build. ``bind`` names a value that an expression reads many times.


def _bind(value: str, name: str, body: str) -> str:
    return f"aggregate(cast(array() as array<int>), {value}, (bound, _) -> bound, {name} -> {body})"


def _named(name: str) -> str:
    """Character of a reference name, NULL when there is no such name."""
    # A name stands for one or two characters.
    char = f"substring_index(substring(known, at + length({name}) + 2, 3), '\\u0002', 1)"
    key = f"concat('\\u0002', {name}, '\\u0003')"
    found = _bind(f"instr(known, {key})", "at", f"if(at > 0, {char}, null)")
    group = f"(ascii({name}) + 7 * ascii(substring({name}, 2, 1))) % {GROUPS} + 1"
    return _bind(f"element_at(s.names, {group})", "known", found)


def _code_point(number: str) -> str:
    """Value of ``65`` or ``x41``; numbers out of range become -1."""
    digits = "trim(leading '0xX' from n)"
    value = f"""case when length({digits}) > 7 then -1 when {digits} = '' then 0
      when n rlike '^[xX]' then cast(conv({digits}, 16, 10) as int)
      else cast({digits} as int) end"""
    return _bind(number, "n", value)


# One character; surrogates and impossible values become U+FFFD, and a decoder
# would take a leading U+FEFF as a byte order mark.
_CHARACTER = f"""translate(
  case when c <= 0 or c > 1114111 or c between 55296 and 57343 then '{REPLACEMENT}'
    when c = 65279 then '\ufeff'
    else decode(unhex(lpad(hex(c), 8, '0')), 'UTF-32') end,
  '{C1_FROM}', '{C1_TO}')"""

# Code points that an attribute value drops.
_DROPPED = """(c between 1 and 8 or c = 11 or c between 14 and 31 or c = 127
  or c between 64976 and 65007 or (c > 0 and c % 65536 in (65534, 65535)))"""

_LITERAL = "concat('&', piece)"


def _number_rule(pattern: str, character: str) -> str:
    number = f"regexp_extract(piece, r'^#({pattern})', 1)"
    char = _bind(_code_point(number), "c", character)
    return f"concat({char}, regexp_replace(piece, r'^#(?:{pattern});?', ''))"


def _text_rule() -> str:
    number = "[0-9]++|[xX][0-9a-fA-F]++"
    name = "[a-zA-Z][-.a-zA-Z0-9]*+"
    # An unknown name stays as it is, without its semicolon.
    named = _bind(
        f"regexp_extract(piece, r'^{name}', 0)",
        "name",
        f"""concat(coalesce({_named("name")}, concat('&', name)),
          regexp_replace(piece, r'^{name};?', ''))""",
    )
    return f"""case
      when piece rlike r'^#(?:{number})(?![0-9a-fA-F])' then {_number_rule(number, _CHARACTER)}
      when piece rlike '^[a-zA-Z]' then {named}
      else {_LITERAL} end"""


def _attribute_rule() -> str:
    number = "[0-9]++|[xX][0-9a-fA-F]++"
    full = r"[^\t\n\f <&#;]{1,32}"
    old = _old_names()
    # A full name with its semicolon, else the longest old name in front.
    by_old_name = _bind(
        f"regexp_extract(piece, r'^(?:{old})', 0)",
        "old",
        f"""if(old = '', {_LITERAL},
          concat({_named("old")}, regexp_replace(piece, r'^(?:{old})', '')))""",
    )
    by_full_name = _bind(
        _bind(f"regexp_extract(piece, r'^({full});', 1)", "name", _named("name")),
        "char",
        f"if(char is null, {by_old_name}, concat(char, regexp_replace(piece, r'^{full};', '')))",
    )
    return f"""case
      when piece rlike r'^#(?:{number})' then
        {_number_rule(number, f"if({_DROPPED}, '', {_CHARACTER})")}
      when startswith(piece, '#') then {_LITERAL}
      else {by_full_name} end"""


@cache
def _decoder(attribute: bool) -> str:
    """Split at ``&`` and rewrite every piece that follows one."""
    rule = _attribute_rule() if attribute else _text_rule()
    return f"""s -> array_join(transform(split(s.text, '&', -1), (piece, i) -> if(i = 0, piece, {rule})), '')"""


def _decode(value: StrCol, attribute: bool) -> Column:
    def decoded(text: Column) -> Column:
        source = F.struct(text.alias("text"), F.split(F.lit(_table()), "\x04", -1).alias("names"))
        pieces = F.call_function("transform", F.array(source), F.expr(_decoder(attribute)))
        return F.when(text.contains("&"), F.get(pieces, F.lit(0))).otherwise(text)

    return let(text_or_empty(value), decoded)


def decode_text(value: StrCol) -> Column:
    """Decode character references in visible text."""
    return _decode(value, attribute=False)


def decode_attribute(value: StrCol) -> Column:
    """Decode character references in an attribute value."""
    return _decode(value, attribute=True)

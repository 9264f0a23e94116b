"""The layout of a fixed-width record, from its copybook.

A statement is cut into words, a literal being one word whatever stands in it.  The words of an entry are a series of clauses
in any order, each with a rule of its own for the words that belong to it; a word that no rule takes is an error,
as a wrong guess would move every later field.  USAGE and SIGN of a group hold for the items in it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

from sediment.functions import ebcdic


@dataclass(frozen=True)
class Field:
    """One elementary item or repeated group: where its bytes are and how they are written.

    `offset` counts a table of variable length at its most; `after` has such tables before the field, and with
    `counter` this field is one itself: it has as many entries as that field says, `least` to `occurs`.
    """

    name: str
    path: tuple[str, ...]
    offset: int
    length: int
    kind: str  # text, comp, comp3, zoned, float or group
    digits: int = 0
    scale: int = 0
    signed: bool = False
    sign: str = "trailing"  # of a zoned number: trailing, leading, or either with "separate"
    occurs: int = 1
    least: int = 1
    counter: Field | None = None
    after: tuple[Field, ...] = ()
    items: tuple[Field, ...] = ()  # of a repeated group, with offsets inside it

    @property
    def repeated(self) -> bool:
        return self.occurs > 1 or self.counter is not None

    @property
    def type(self) -> T.DataType:
        if self.kind in ("text", "group") or self.repeated:
            return T.StringType()
        if self.kind == "float":
            return T.FloatType() if self.length == 4 else T.DoubleType()
        return ebcdic.number_type(self.digits, self.scale)


# The bytes a binary item takes, by its number of digits.
_COMP_BYTES = ((4, 2), (9, 4), (18, 8))

# The words for a usage.  The floating ones have no picture; their bytes are fixed.
_USAGES = {
    "COMP": "comp", "COMP-4": "comp", "COMP-5": "comp", "BINARY": "comp", "COMP-3": "comp3", "PACKED-DECIMAL": "comp3",
    "DISPLAY": "zoned", "COMP-1": "float4", "COMP-2": "float8",
}
_USAGES |= {k.replace("COMP", "COMPUTATIONAL"): v for k, v in _USAGES.items() if k.startswith("COMP")}
_FLOATS = {"float4": 4, "float8": 8}

# Words that stand for a value, and what links two of them.
_VALUE_WORDS = {
    "ZERO", "ZEROS", "ZEROES", "SPACE", "SPACES", "HIGH-VALUE", "HIGH-VALUES", "LOW-VALUE", "LOW-VALUES", "QUOTE", "QUOTES",
    "NULL", "NULLS", "ALL", "THRU", "THROUGH",
}


@dataclass
class Entry:
    """One entry of a copybook with the entries below it."""

    level: int
    name: str
    picture: str | None = None
    usage: str | None = None
    sign: str | None = None
    occurs: int = 1
    least: int | None = None  # of a table whose length a counter gives
    counter: str | None = None
    redefines: str | None = None
    below: list[Entry] = field(default_factory=list)


class _Words:
    """The words of a statement, taken from the front."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self) -> str:
        return self.words[self.at].upper() if self.at < len(self.words) else ""

    def take(self, *optional: str) -> str:
        """The next word, behind words that may stand before it."""
        self.skip(*optional)
        if self.at == len(self.words):
            raise ValueError(f"{' '.join(self.words)!r} ends inside a clause")
        self.at += 1
        return self.words[self.at - 1]

    def skip(self, *optional: str) -> bool:
        found = False
        while self.peek() and self.peek() in optional:
            self.at += 1
            found = True
        return found

    def number(self) -> int:
        word = self.take()
        if not word.isdigit():
            raise ValueError(f"{' '.join(self.words)!r} has {word!r} for a number")
        return int(word)

    def names(self) -> list[str]:
        """Names up to the next clause."""
        out = []
        while self.peek() and self.peek() not in _CLAUSES and self.peek() not in _USAGES:
            out.append(self.take().upper())
        return out


def _picture_clause(e: Entry, w: _Words) -> None:
    e.picture = w.take("IS").upper()


def _usage_clause(e: Entry, w: _Words) -> None:
    word = w.take("IS").upper()
    if word not in _USAGES:
        raise ValueError(f"{e.name}: the usage {word} is not supported")
    e.usage = _USAGES[word]


def _sign_clause(e: Entry, w: _Words) -> None:
    side = w.take("IS").lower()
    if side not in ("leading", "trailing"):
        raise ValueError(f"{e.name}: a sign is LEADING or TRAILING, not {side!r}")
    e.sign = side + (" separate" if w.skip("SEPARATE") else "")
    w.skip("CHARACTER")


def _bare_sign(side: str) -> Callable[[Entry, _Words], None]:
    def clause(e: Entry, w: _Words) -> None:
        e.sign = side + (" separate" if w.skip("SEPARATE") else "")
        w.skip("CHARACTER")

    return clause


def _occurs_clause(e: Entry, w: _Words) -> None:
    e.occurs = w.number()
    if w.skip("TO"):
        e.least, e.occurs = e.occurs, w.number()
    w.skip("TIMES")
    if w.skip("DEPENDING"):
        e.counter = w.take("ON").upper()
        e.least = 0 if e.least is None else e.least
    elif e.least is not None:
        raise ValueError(f"{e.name}: a table of variable length needs DEPENDING ON")


def _redefines_clause(e: Entry, w: _Words) -> None:
    e.redefines = w.take().upper()


def _value_clause(e: Entry, w: _Words) -> None:
    w.skip("IS", "ARE")
    while w.peek() and (w.peek() in _VALUE_WORDS or re.match(r"""[XNZGB]?['"]|[+-]?[0-9]*[.,]?[0-9]+$""", w.peek())):
        w.take()


def _names_clause(*before: str) -> Callable[[Entry, _Words], None]:
    def clause(e: Entry, w: _Words) -> None:
        w.skip(*before)
        w.names()

    return clause


def _without(*words: str) -> Callable[[Entry, _Words], None]:
    def clause(e: Entry, w: _Words) -> None:
        w.skip(*words)

    return clause


#: How each clause takes its words; those of the second half say nothing about the layout.
_CLAUSES: dict[str, Callable[[Entry, _Words], None]] = {
    "PIC": _picture_clause, "PICTURE": _picture_clause, "USAGE": _usage_clause, "SIGN": _sign_clause,
    "LEADING": _bare_sign("leading"), "TRAILING": _bare_sign("trailing"), "OCCURS": _occurs_clause, "REDEFINES": _redefines_clause,
    "VALUE": _value_clause, "VALUES": _value_clause, "JUST": _without("RIGHT"), "JUSTIFIED": _without("RIGHT"),
    "BLANK": _without("WHEN", "ZERO", "ZEROS", "ZEROES"), "INDEXED": _names_clause("BY"),
    "ASCENDING": _names_clause("KEY", "IS"), "DESCENDING": _names_clause("KEY", "IS"), "GLOBAL": _without(), "EXTERNAL": _without(),
}


def _entry(words: list[str]) -> Entry:
    if not words[0].isdigit():
        raise ValueError(f"{' '.join(words)!r} does not begin with a level number")
    w = _Words(words)
    level = w.number()
    named = w.peek() and w.peek() not in _CLAUSES and w.peek() not in _USAGES
    e = Entry(level, w.take().upper() if named else "FILLER")
    while w.peek():
        word = w.take().upper()
        if word in _CLAUSES:
            _CLAUSES[word](e, w)
        elif word in _USAGES:
            e.usage = _USAGES[word]
        else:
            raise ValueError(f"{e.name}: {' '.join(words[1:])!r} is not supported, because of {word}")
    return e


def _code(copybook: str) -> str:
    """The lines without sequence numbers, right margin and comments; a continued line goes on where the last one ended."""
    lines: list[str] = []
    for line in copybook.expandtabs().splitlines():
        if len(line) <= 7 or line[6] in "*/dD":
            continue
        text = line[7:72]
        if line[6] == "-" and lines:
            rest = text.lstrip()
            quote = _open_quote(lines[-1])
            if quote and rest.startswith(quote):
                lines[-1] = lines[-1].ljust(65) + rest[1:]
            else:
                lines[-1] = lines[-1].rstrip() + rest
        else:
            lines.append(text)
    return "\n".join(lines)


def _open_quote(text: str) -> str:
    """The quote of a literal that has no end."""
    quote = ""
    for c in text:
        if c in "'\"":
            quote = "" if c == quote else quote or c
    return quote


_TOKEN = re.compile(r"""\s+|[,;](?=\s)|(?P<end>\.(?=\s|$))|(?P<word>(?:[XNZGB](?=['"]))?(?:'(?:[^'\n]|'')*'|"(?:[^"\n]|"")*")|(?:(?!\.(?:\s|$)|[,;]\s)[^\s'"])+)""", re.IGNORECASE)


def _statements(copybook: str) -> Iterator[list[str]]:
    """The words of each statement."""
    code, at, words = _code(copybook), 0, []
    while at < len(code):
        found = _TOKEN.match(code, at)
        if not found:
            raise ValueError(f"a literal has no end: {code[at : at + 40]!r}")
        at = found.end()
        if found["word"]:
            words.append(found["word"])
        if found["end"] and words:
            yield words
            words = []
    if words:
        yield words


def _tree(copybook: str) -> list[Entry]:
    """The top entries of a copybook; condition names (level 88) take no room."""
    tops: list[Entry] = []
    open_: list[Entry] = []
    for words in _statements(copybook):
        if words[0].isdigit() and int(words[0]) == 88:
            continue
        e = _entry(words)
        if e.level == 66:
            raise ValueError(f"{e.name}: RENAMES is not supported")
        while open_ and (open_[-1].level >= e.level or e.level == 77):
            open_.pop()
        if open_ and open_[-1].picture is not None:
            raise ValueError(f"{open_[-1].name} has a picture and items below it")
        (open_[-1].below if open_ else tops).append(e)
        open_.append(e)
    return tops


# The characters of a picture of text and of edited numbers, which are text of their own width.
_TEXT, _EDITED = set("XA"), set("XA9BZ0/*+-$,.CRDP")


def picture(pic: str) -> tuple[bool, int, int, bool]:
    """(is text, digits or characters, scale, signed) of a PICTURE string."""
    spelled = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), pic.upper())
    number = re.fullmatch(r"(S?)(9*)(?:V(P*)(9*))?", spelled)
    if number and (number[2] or number[4]):
        places = len(number[3] or "") + len(number[4] or "")
        return False, len(number[2]) + len(number[4] or ""), places, bool(number[1])
    if set(spelled) <= _TEXT:
        return True, len(spelled), 0, False
    if set(spelled) <= _EDITED and "P" not in spelled:
        return True, len(spelled), 0, False
    raise ValueError(f"unsupported picture {pic!r}")


@dataclass(frozen=True)
class _Scope:
    """What holds for the entries of a group."""

    path: tuple[str, ...] = ()
    usage: str | None = None
    sign: str | None = None
    fixed: str = ""  # why no table of variable length can be here


class _Layout:
    """Places entries one behind the other and collects their fields."""

    def __init__(self, variable: bool):
        self.variable = variable
        self.counters: dict[str, Field] = {}
        self.after: tuple[Field, ...] = ()

    def place(self, entries: list[Entry], offset: int, scope: _Scope) -> tuple[list[Field], int]:
        """The fields of the entries of one group, and where they end."""
        redefined = {e.redefines for e in entries if e.redefines}
        fields: list[Field] = []
        end, start, area = offset, (offset, self.after), set()  # an area is an item and those that redefine it
        for e in entries:
            if e.redefines and e.redefines not in area:
                raise ValueError(f"{e.name} redefines {e.redefines}, which is not the item before it")
            if not e.redefines:
                start, area = (end, self.after), set()
            at, self.after = start
            area.add(e.name)
            shared = e.redefines or e.name in redefined
            own, past = self.item(e, at, replace(scope, fixed=scope.fixed or "an area that is redefined") if shared else scope)
            fields += own
            end = max(end, past)
        return fields, end

    def item(self, e: Entry, offset: int, scope: _Scope) -> tuple[list[Field], int]:
        table = e.occurs > 1 or e.counter is not None
        path = scope.path if e.name == "FILLER" and e.below and not table else (*scope.path, e.name)
        usage, sign = e.usage or scope.usage, e.sign or scope.sign
        if e.usage and scope.usage and e.usage != scope.usage:
            raise ValueError(f"{e.name} has another usage than its group")
        if e.picture is None and not e.below and usage not in _FLOATS:
            raise ValueError(f"{e.name} has neither a picture nor items")
        if e.counter and scope.fixed and (self.variable or scope.fixed == "a table"):
            raise ValueError(f"{e.name}: a table of variable length in {scope.fixed} is not supported")
        if e.below and not table:
            return self.place(e.below, offset, replace(scope, path=path, usage=usage, sign=sign))
        where = {"name": "_".join(path).replace("-", "_"), "path": path, "offset": offset, "after": self.after}
        where |= {"occurs": e.occurs, "least": e.least or 0, "counter": self.counter(e) if e.counter else None}
        if e.below:
            before, self.after = self.after, ()
            items, length = self.place(e.below, 0, _Scope((), usage, sign, "a table"))
            self.after = before
            found = Field(**where, length=length, kind="group", items=tuple(items))
        else:
            found = self.elementary(e, usage, sign, where)
        if self.variable and e.counter:
            self.after = (*self.after, found)
        if scope.fixed != "a table" and not table and e.name != "FILLER":
            self.counters[e.name] = found
        return [found], offset + found.length * found.occurs

    def elementary(self, e: Entry, usage: str | None, sign: str | None, where: dict) -> Field:
        if usage in _FLOATS:
            if e.picture is not None:
                raise ValueError(f"{e.name}: a floating item has no picture")
            return Field(**where, length=_FLOATS[usage], kind="float", signed=True)
        is_text, size, scale, signed = picture(e.picture)
        if is_text:
            if usage in ("comp", "comp3"):
                raise ValueError(f"{e.name}: text can't be {usage}")
            return Field(**where, length=size, kind="text", digits=size)
        if max(size, scale) > 38 or usage == "comp" and size > 18:
            raise ValueError(f"{e.name} has too many digits: {size}")
        kind, length = usage or "zoned", size
        if kind == "comp3":
            length = size // 2 + 1
        elif kind == "comp":
            length = next(b for most, b in _COMP_BYTES if size <= most)
        elif signed and sign and sign.endswith("separate"):
            length = size + 1
        return Field(**where, length=length, kind=kind, digits=size, scale=scale, signed=signed, sign=sign or "trailing")

    def counter(self, e: Entry) -> Field:
        found = self.counters.get(e.counter)
        if found is None or found.kind in ("text", "float", "group") or found.scale:
            raise ValueError(f"{e.name}: {e.counter} is no whole number before the table")
        return found


def read_copybook(copybook: str, *, variable_size_occurs: bool = False) -> tuple[Field, ...]:
    """The items of a record in order, FILLER included.

    Names are the group path below the record joined by `_`, without FILLER.  What OCCURS, an item or a group, is one text column with the
    JSON array of its values, as many as the counter says where there is one.  An item that REDEFINES another is a column
    of its own over the same bytes; the area is as long as the longest.  A table that DEPENDS ON a counter takes the room of its
    most entries, as in a fixed record; with `variable_size_occurs` it takes the room of the entries it has, and the fields behind it move.
    RENAMES, SYNCHRONIZED, national text and pointers are refused.
    """
    tops = _tree(copybook)
    if len(tops) == 1 and tops[0].picture is None and tops[0].occurs == 1:
        scope = _Scope((), tops[0].usage, tops[0].sign)
        tops = tops[0].below
    else:
        scope = _Scope()
    fields, _ = _Layout(variable_size_occurs).place(tops, 0, scope)
    if not fields:
        raise ValueError("the copybook describes no field")
    names = [f.name for f in named(fields)]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several items would be the column {', '.join(twice)}")
    return tuple(fields)


def record_length(layout: Iterable[Field]) -> int:
    return max(f.offset + f.length * f.occurs for f in layout)


def named(layout: Iterable[Field]) -> list[Field]:
    return [f for f in layout if f.path[-1] != "FILLER"]


def layout_schema(layout: Iterable[Field]) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, f.type, True, {"path": list(f.path)}) for f in named(layout)]
    )

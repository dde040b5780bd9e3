"""Translate RE2-syntax patterns and ``$``-templates to Java's dialect.

Items are matched with RE2 semantics (the reference uses Go's ``regexp``),
while Spark's ``rlike``/``regexp_replace`` run ``java.util.regex``. The
translation runs once on the driver; the pattern then stays a foldable
literal, compiled once per task, inside whole-stage codegen.

Differences handled:

* ``.`` excludes only ``\\n``           -> every pattern starts with ``(?d)``
* ``$`` is end of text unless ``(?m)``  -> ``\\z`` (Java's ``$`` also matches
  before a final newline)
* ``\\b``/``\\B`` are ASCII word bounds   -> look-around on ``\\w`` (Java's
  ``\\b`` sees Unicode letters)
* ``\\s`` is ``[\\t\\n\\f\\r ]``            -> spelled out (Java adds ``\\x0B``)
* ``\\v`` is U+000B                      -> ``\\x0B`` (Java: a class)
* ``(?i)`` folds Unicode                -> ``(?iu)``
* ``(?P<name>``, names with ``_``      -> every capture becomes ``(?<gN>``
* ``[[:alpha:]]``                       -> ``\\p{Alpha}``
* ``[`` and ``&`` inside a class are literal -> escaped
* a ``{`` that is not a repetition is literal -> escaped
* octal ``\\123``                        -> ``\\x{53}``

Constructs RE2 rejects raise ``RegexError`` even where Java would accept
them: look-around, back-references, possessive and nested repetition,
atomic groups, ``\\C``, ``\\Z``, ``(?U)``, repetition counts above 1000.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Fixed values of the RE2 dialect.
RE2_SPACE = "\\t\\n\\f\\r "
POSIX_CLASSES = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}",
    "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}",
    "graph": "\\p{Graph}", "lower": "\\p{Lower}", "print": "\\p{Print}",
    "punct": "\\p{Punct}", "space": "\\p{Space}", "upper": "\\p{Upper}",
    "word": "\\w", "xdigit": "\\p{XDigit}",
}
POSIX_NEGATED = {
    "alnum": "\\P{Alnum}", "alpha": "\\P{Alpha}", "ascii": "\\P{ASCII}",
    "blank": "\\P{Blank}", "cntrl": "\\P{Cntrl}", "digit": "\\P{Digit}",
    "graph": "\\P{Graph}", "lower": "\\P{Lower}", "print": "\\P{Print}",
    "punct": "\\P{Punct}", "space": "\\P{Space}", "upper": "\\P{Upper}",
    "word": "\\W", "xdigit": "\\P{XDigit}",
}
GENERAL_CATEGORIES = {
    "C", "Cc", "Cf", "Co", "Cs", "L", "Ll", "Lm", "Lo", "Lt", "Lu", "M", "Mc",
    "Me", "Mn", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Pe", "Pf", "Pi", "Po",
    "Ps", "S", "Sc", "Sk", "Sm", "So", "Z", "Zl", "Zp", "Zs",
}
WORD_BOUNDARY = "(?:(?<=\\w)(?!\\w)|(?<!\\w)(?=\\w))"
NOT_WORD_BOUNDARY = "(?:(?<=\\w)(?=\\w)|(?<!\\w)(?!\\w))"
MAX_REPEAT = 1000

_REPEAT = re.compile(r"\{(\d+)(,(\d*))?\}")
_NAME = re.compile(r"[A-Za-z0-9_]+")
_FLAGS = re.compile(r"\(\?([imsU]*(?:-[imsU]*)?)([:)])")


class RegexError(ValueError):
    """The pattern is not valid RE2 syntax (or uses what we refuse)."""


@dataclass
class Translated:
    pattern: str
    groups: int
    names: dict[str, int] = field(default_factory=dict)


def _esc_literal(ch: str) -> str:
    if ch.isalnum() or ch == "_" or ord(ch) > 127:
        return ch
    return "\\" + ch


def _code(cp: int) -> str:
    return "\\x{%X}" % cp


def _escape(p: str, i: int, in_class: bool) -> tuple[str, int]:
    """Translate the escape starting at p[i] == '\\'. Returns (java, next index)."""
    if i + 1 >= len(p):
        raise RegexError("trailing backslash at end of expression")
    c = p[i + 1]
    j = i + 2
    if c in "dDwW":
        return "\\" + c, j
    if c == "s":
        return (RE2_SPACE if in_class else "[" + RE2_SPACE + "]"), j
    if c == "S":
        return "[^" + RE2_SPACE + "]", j
    if c in "pP":
        neg = c == "P"
        if j < len(p) and p[j] == "{":
            end = p.find("}", j)
            if end < 0:
                raise RegexError("invalid character class range")
            name = p[j + 1:end]
            j = end + 1
        elif j < len(p):
            name = p[j]
            j += 1
        else:
            raise RegexError("invalid character class range")
        if name.startswith("^"):
            neg, name = not neg, name[1:]
        if name == "Any":
            body = "\\x{0}-\\x{10FFFF}"
            return ("[^" + body + "]" if neg else "[" + body + "]"), j
        if not name or not re.fullmatch(r"[A-Za-z_]+", name):
            raise RegexError("invalid character class range")
        jn = name if name in GENERAL_CATEGORIES else "Is" + name
        return ("\\P{" if neg else "\\p{") + jn + "}", j
    if c == "Q" and not in_class:
        end = p.find("\\E", j)
        lit = p[j:] if end < 0 else p[j:end]
        return "".join(_esc_literal(ch) for ch in lit), (len(p) if end < 0 else end + 2)
    if c == "x":
        if j < len(p) and p[j] == "{":
            end = p.find("}", j)
            if end < 0 or not re.fullmatch(r"[0-9A-Fa-f]+", p[j + 1:end]):
                raise RegexError("invalid escape sequence")
            cp = int(p[j + 1:end], 16)
            if cp > 0x10FFFF:
                raise RegexError("invalid escape sequence")
            return _code(cp), end + 1
        h = p[j:j + 2]
        if len(h) != 2 or not re.fullmatch(r"[0-9A-Fa-f]{2}", h):
            raise RegexError("invalid escape sequence")
        return _code(int(h, 16)), j + 2
    if c in "01234567":
        # \0, \0nn, or \nnn with at least two digits; a lone \1-\7 is a
        # back-reference, which RE2 does not have.
        k = i + 1
        if c != "0" and not (j < len(p) and p[j] in "01234567"):
            raise RegexError("invalid escape sequence")
        digits = ""
        while k < len(p) and len(digits) < 3 and p[k] in "01234567":
            digits += p[k]
            k += 1
        return _code(int(digits, 8)), k
    if c in "89":
        raise RegexError("invalid escape sequence")
    simple = {"a": "\\x{7}", "f": "\\f", "t": "\\t", "n": "\\n", "r": "\\r", "v": "\\x{B}"}
    if c in simple:
        return simple[c], j
    if not in_class:
        if c == "A":
            return "\\A", j
        if c == "z":
            return "\\z", j
        if c == "b":
            return WORD_BOUNDARY, j
        if c == "B":
            return NOT_WORD_BOUNDARY, j
    if ord(c) < 128 and not c.isalnum():
        return "\\" + c, j
    raise RegexError("invalid escape sequence")


def _char_class(p: str, i: int) -> tuple[str, int]:
    """Translate the class starting at p[i] == '['."""
    out = ["["]
    j = i + 1
    if j < len(p) and p[j] == "^":
        out.append("^")
        j += 1
    first = True
    while True:
        if j >= len(p):
            raise RegexError("missing closing ]")
        ch = p[j]
        if ch == "]" and not first:
            out.append("]")
            return "".join(out), j + 1
        first = False
        if ch == "[" and p.startswith("[:", j):
            end = p.find(":]", j + 2)
            if end >= 0:
                name = p[j + 2:end]
                neg = name.startswith("^")
                key = name[1:] if neg else name
                table = POSIX_NEGATED if neg else POSIX_CLASSES
                if key not in table:
                    raise RegexError("invalid character class range")
                out.append(table[key])
                j = end + 2
                continue
        if ch == "\\":
            lit, j = _escape(p, j, in_class=True)
            if lit.startswith("[^"):
                out.append(lit)  # nested negated class is a union in Java
            else:
                out.append(lit)
            continue
        if ch in "[]&^":
            out.append("\\" + ch)
        else:
            out.append(ch)
        j += 1


def _is_word_literal(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _one_sided_boundary(p: str, start: int, end: int, word: bool, out: list[str]) -> str | None:
    """``\\b`` next to a literal ASCII word character needs only one look-around
    (the literal side is known to be a word character); Java evaluates that
    about twice as fast as the two-sided form. None when it does not apply."""
    nxt = p[end] if end < len(p) else ""
    after = p[end + 1] if end + 1 < len(p) else ""
    if _is_word_literal(nxt) and after not in ("?", "*", "{"):
        return "(?<!\\w)" if word else "(?<=\\w)"
    prev = out[-1] if out else ""
    if len(prev) == 1 and _is_word_literal(prev) and start > 0 and p[start - 1] == prev:
        return "(?!\\w)" if word else "(?=\\w)"
    return None


_NEVER_EMPTY = re.compile(r"(?:[^\\*?{|^$()\[\]]|\\[^bBAzQEpP0-9])*")


def replaceable(p: str, t: Translated) -> str:
    """The Java pattern for replacing every match of ``p``.

    RE2 takes no empty match right where the previous match ended, Java does;
    Java also finds empty matches between the two halves of a surrogate pair.
    Patterns that may match empty are therefore wrapped: the match is made as
    ever (atomic, so no other one is tried instead) and must end away from the
    end of the last one (``\\G``), except at the start of the text."""
    if _NEVER_EMPTY.fullmatch(p):
        return t.pattern
    return r"(?!\p{Cs})(?>" + t.pattern + r")(?:(?!\G)|\A)"


def translate_pattern(p: str) -> Translated:
    out: list[str] = ["(?d)"]
    names: dict[str, int] = {}
    groups = 0
    # stack of multi-line flag per open group (True when (?m) is active)
    stack: list[bool] = []
    multiline = False
    # what the last token allows next: 'atom' may be repeated; 'rep' was a
    # repetition (a '?' may follow once to make it lazy); 'lazy' ends it.
    last = "start"
    i = 0
    n = len(p)
    while i < n:
        ch = p[i]
        if ch == "\\":
            start = i
            lit, i = _escape(p, i, in_class=False)
            if lit in (WORD_BOUNDARY, NOT_WORD_BOUNDARY):
                lit = _one_sided_boundary(p, start, i, lit == WORD_BOUNDARY, out) or lit
            out.append(lit)
            last = "atom"
            continue
        if ch == "[":
            lit, i = _char_class(p, i)
            out.append(lit)
            last = "atom"
            continue
        if ch == "(":
            if p.startswith("(?P<", i) or (p.startswith("(?<", i) and not p.startswith("(?<=", i)
                                           and not p.startswith("(?<!", i)):
                start = i + (4 if p.startswith("(?P<", i) else 3)
                end = p.find(">", start)
                name = p[start:end] if end >= 0 else ""
                if end < 0 or not _NAME.fullmatch(name):
                    raise RegexError("invalid named capture")
                if name in names:
                    raise RegexError("duplicate capture group name")
                groups += 1
                names[name] = groups
                out.append(f"(?<g{groups}>")
                stack.append(multiline)
                i = end + 1
                last = "start"
                continue
            if p.startswith("(?", i):
                m = _FLAGS.match(p, i)
                if not m:
                    raise RegexError("invalid or unsupported Perl syntax")
                flags = m.group(1)
                if flags.endswith("-") or (flags == "" and m.group(2) == ")"):
                    raise RegexError("missing or dangling flags")
                if "U" in flags:
                    raise RegexError("ungreedy flag (?U) is not supported")
                on, _, off = flags.partition("-")
                jflags = on.replace("i", "iu") + ("-" + off if off else "")
                new_ml = (multiline or "m" in on) and "m" not in off
                if m.group(2) == ")":
                    out.append(f"(?{jflags})" if flags else "")
                    multiline = new_ml
                    last = "start" if last == "start" else last
                else:
                    out.append(f"(?{jflags}:")
                    stack.append(multiline)
                    multiline = new_ml
                    last = "start"
                i = m.end()
                continue
            groups += 1
            out.append(f"(?<g{groups}>")
            stack.append(multiline)
            i += 1
            last = "start"
            continue
        if ch == ")":
            if not stack:
                raise RegexError("unexpected )")
            multiline = stack.pop()
            out.append(")")
            i += 1
            last = "atom"
            continue
        if ch == "|":
            out.append("|")
            i += 1
            last = "start"
            continue
        if ch in "*+?":
            if last == "start":
                raise RegexError("missing argument to repetition operator")
            if last == "rep" and ch == "?":
                out.append("?")
                last = "lazy"
                i += 1
                continue
            if last in ("rep", "lazy"):
                raise RegexError("invalid nested repetition operator")
            out.append(ch)
            last = "rep"
            i += 1
            continue
        if ch == "{":
            m = _REPEAT.match(p, i)
            if m:
                lo = int(m.group(1))
                hi = m.group(3)
                if lo > MAX_REPEAT or (hi not in (None, "") and (int(hi) > MAX_REPEAT or int(hi) < lo)):
                    raise RegexError("invalid repeat count")
                if last == "start":
                    raise RegexError("missing argument to repetition operator")
                if last in ("rep", "lazy"):
                    raise RegexError("invalid nested repetition operator")
                out.append(m.group(0))
                last = "rep"
                i = m.end()
                continue
            out.append("\\{")
            last = "atom"
            i += 1
            continue
        if ch == "}":
            out.append("\\}")
            last = "atom"
            i += 1
            continue
        if ch == "$":
            out.append("$" if multiline else "\\z")
            last = "atom"
            i += 1
            continue
        if ch == "^":
            # Java's multi-line ^ leaves out the place after a final line break
            out.append("(?:^|(?<=\\n))" if multiline else "^")
            last = "atom"
            i += 1
            continue
        if ch == ".":
            out.append(".")
            last = "atom"
            i += 1
            continue
        out.append(ch if (ch.isalnum() or ord(ch) > 127 or ch in " _-,:;'\"=!<>@%/~`&#") else "\\" + ch)
        last = "atom"
        i += 1
    if stack:
        raise RegexError("missing closing )")
    return Translated("".join(out), groups, names)


def translate_replacement(template: str, t: Translated) -> str:
    """Go ``Expand`` template -> Java replacement string.

    ``$name``/``${name}``: the longest run of letters, digits and ``_``;
    all digits (no leading zero) is a group number, otherwise a group
    name; unknown or out-of-range -> empty. ``$$`` is ``$``; a ``$`` not
    followed by a valid name is literal; backslash is literal.
    """
    out: list[str] = []
    i, n = 0, len(template)
    while i < n:
        ch = template[i]
        if ch != "$":
            out.append("\\\\" if ch == "\\" else ch)
            i += 1
            continue
        if i + 1 < n and template[i + 1] == "$":
            out.append("\\$")
            i += 2
            continue
        j = i + 1
        brace = j < n and template[j] == "{"
        if brace:
            j += 1
        k = j
        while k < n and (template[k].isalnum() or template[k] == "_"):
            k += 1
        name = template[j:k]
        if not name or (brace and (k >= n or template[k] != "}")):
            out.append("\\$")
            i += 1
            continue
        end = k + 1 if brace else k
        num = int(name) if name.isdigit() and name.isascii() and not (name[0] == "0" and len(name) > 1) \
            and len(name) < 9 else -1
        if num >= 0:
            if num == 0:
                out.append("$0")
            elif num <= t.groups:
                out.append("${g%d}" % num)
        elif name in t.names:
            out.append("${g%d}" % t.names[name])
        i = end
    return "".join(out)


def java_compiles(spark, pattern: str) -> bool:
    """Check a translated pattern with the JVM's own compiler (driver side)."""
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # Spark Connect: no JVM handle; trust the translator
        return True
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:
        return False


def compile_re2(pattern: str, spark=None) -> Translated:
    """Translate and validate; raises RegexError when invalid."""
    t = translate_pattern(pattern)
    if spark is not None and not java_compiles(spark, t.pattern):
        raise RegexError(f"pattern not supported: {pattern!r}")
    return t

"""Tokens of source code, for the Arrow batches of operators/code_rows: C and Rust by one pattern, assembly by lines.

No grammar is built. Names are told apart by what stands next to them: a name before ( or ! is a function, one after . or
-> a field, one after a type keyword or in capitals-and-small letters a type. Code whose brackets do not match has no
fingerprint.
"""

import hashlib
import re

#: Words of the languages' specifications.
KEYWORDS = {
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "c": frozenset("auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while".split()),
}
PRIMITIVES = frozenset("bool char double f32 f64 float i8 i16 i32 i64 i128 int isize long short signed str u8 u16 u32 u64 u128 unsigned usize void".split())
TYPE_WORDS = frozenset("struct enum union trait impl type".split())
CONTROL = frozenset("if else match switch case for while loop do return break continue goto".split())

_TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>[brLu]{0,2}(?P<hash>\#*)"(?(hash)(?:[^"\\]|\\.|"(?!(?P=hash)))*)"(?P=hash))"""
    r"""|(?P<char>b?'(?:\\[^\n]{1,8}?|[^'\\\n])')|(?P<lifetime>'[A-Za-z_]\w*)|(?P<number>0[xXbBoO][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.[0-9][0-9_]*)?\w*)"""
    r"""|(?P<name>[A-Za-z_]\w*)|(?P<sign>->|=>|::|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|[^\s\w])""",
    re.S | re.X,
)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


def lex(code: str) -> list[tuple[str, str, int]]:
    """Kind, text and place of each token but comments."""
    return [(m.lastgroup if m.lastgroup != "hash" else "string", m[0], m.start()) for m in _TOKEN.finditer(code) if not m["comment"]]


def balanced(tokens: list[tuple[str, str, int]]) -> bool:
    want: list[str] = []
    for kind, text, _ in tokens:
        if kind == "sign" and text in _OPEN:
            want.append(_OPEN[text])
        elif kind == "sign" and text in _CLOSE and (not want or want.pop() != text):
            return False
    return not want


def number(text: str) -> str:
    """INT_HEX, INT_S for 0 to 10, INT_M for all else."""
    low = text.lower()
    if low.startswith("0x"):
        return "INT_HEX"
    digits = re.match(r"[0-9_]+", low)[0].replace("_", "")
    whole = not low.startswith(("0b", "0o")) and low[len(digits) : len(digits) + 1] != "."
    return "INT_S" if whole and int(digits) <= 10 else "INT_M"


def inner(string: str) -> str:
    return string[string.index('"') + 1 :].rstrip("#").removesuffix('"')


def roles(tokens: list[tuple[str, str, int]], lang: str) -> list[str]:
    """What each token is: keyword, type, field, call, var, or its kind."""
    words, out = KEYWORDS.get(lang, frozenset()), []
    for k, (kind, text, _) in enumerate(tokens):
        before = tokens[k - 1][1] if k else ""
        after = tokens[k + 1][1] if k + 1 < len(tokens) else ""
        if kind != "name":
            out.append(kind)
        elif text in words:
            out.append("keyword")
        elif text in PRIMITIVES or before in TYPE_WORDS or re.fullmatch(r"[A-Z]\w*[a-z]\w*|\w+_t", text):
            out.append("type")
        elif after == "(" or (lang == "rust" and after == "!" and tokens[k + 2 : k + 3] and tokens[k + 2][1] in _OPEN):
            out.append("call")
        else:
            out.append("field" if before in (".", "->") else "var")
    return out


def normalized(code: str, lang: str, keep: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """Code without comments, with STR for strings, number classes, and names numbered as they first appear; its strings of
    eight characters or more. A name called anywhere in the code is FUNC_n, others VAR_n; types, fields and keep stay."""
    tokens = lex(code)
    kinds = roles(tokens, lang)
    called = {t for (_, t, _), r in zip(tokens, kinds, strict=True) if r == "call"}
    numbers: dict[str, str] = {}
    count = {"FUNC": 0, "VAR": 0}
    out, strings = [], []
    for (_, text, _), role in zip(tokens, kinds, strict=True):
        if role in ("string", "char"):
            out.append("STR")
            if role == "string" and len(inner(text)) >= 8:
                strings.append(inner(text))
        elif role == "number":
            out.append(number(text))
        elif role in ("call", "var") and text not in keep:
            if text not in numbers:
                head = "FUNC" if text in called else "VAR"
                numbers[text] = f"{head}_{count[head]}"
                count[head] += 1
            out.append(numbers[text])
        else:
            out.append(text)
            if text in (";", "{", "}"):
                out.append("\n")
    return "\n".join(x for x in (line.strip() for line in " ".join(out).split("\n")) if x), strings


def features(code: str, lang: str, libraries: frozenset[str] = frozenset()) -> list[str]:
    """Sorted distinct cf:, ty:, lib: and call: tokens."""
    tokens = lex(code)
    found = set()
    for (_, text, _), role in zip(tokens, roles(tokens, lang), strict=True):
        if role == "keyword" and text in CONTROL:
            found.add(f"cf:{text}")
        elif role == "type":
            found.add(f"ty:{text}")
        elif role in ("call", "var") and text in libraries:
            found.add(f"lib:{text}")
        elif role == "call":
            found.add(f"call:{text}")
    return sorted(found)


def fingerprint(code: str, lang: str) -> str | None:
    """A hash of the tokens with kinds and lengths; none for other languages, no tokens, or brackets that do not match."""
    tokens = lex(code) if lang in KEYWORDS else []
    if not tokens or not balanced(tokens):
        return None
    h = hashlib.sha256()
    for kind, text, _ in tokens:
        data = text.encode("utf-8", "surrogatepass")
        h.update(f"{kind}:{len(data)}:".encode() + data)
    return h.hexdigest()


def masked(code: str) -> str:
    """The code with comments and literals blanked out, every other character in its place."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0]) if m["comment"] or m["string"] or m["char"] else m[0]
    return _TOKEN.sub(blank, code)


def closing(text: str, at: int) -> int | None:
    """The place of the bracket that closes the one at `at`, in masked code."""
    want: list[str] = []
    for k in range(at, len(text)):
        if text[k] in _OPEN:
            want.append(_OPEN[text[k]])
        elif text[k] in _CLOSE:
            if not want or want.pop() != text[k]:
                return None
            if not want:
                return k
    return None


def parameters(code: str) -> int | None:
    """Parameters of the first declaration; none without a list. Commas inside brackets and <> do not count."""
    text = masked(code)
    head = re.search(r"[A-Za-z_]\w*\s*(?:<[^<>()]*>)?\s*\(", text)
    end = closing(text, head.end() - 1) if head else None
    if end is None:
        return None
    depth, commas = 0, 0
    body = text[head.end() : end].strip()
    body = body.removesuffix(",") if code[head.end() : end].rstrip().endswith(",") else body
    for k, c in enumerate(body):
        depth += (c in "([{<") - (c in ")]}" or (c == ">" and body[k - 1 : k] not in "-="))
        commas += c == "," and depth == 0
    return 0 if body in ("", "void") else commas + 1


def behavior(code: str, lang: str) -> tuple[list[str], list[str]]:
    """What code does (calls, fields, constants in capitals, strings of eight characters) and its control words, sorted."""
    tokens = lex(code)
    acts, control = set(), set()
    for (_, text, _), role in zip(tokens, roles(tokens, lang), strict=True):
        if role in ("call", "field") or (role == "var" and re.fullmatch(r"[A-Z][A-Z0-9_]{2,}", text)):
            acts.add(text)
        elif role == "string" and len(inner(text)) >= 8:
            acts.add(inner(text))
        elif role == "keyword" and text in CONTROL:
            control.add(text)
    return sorted(acts), sorted(control)


_HEADS = {
    "rust": re.compile(r"\bfn\s+(?P<fn>[A-Za-z_]\w*)|\bmacro_rules!\s*(?P<macro>[A-Za-z_]\w*)"),
    "c": re.compile(r"(?P<fn>[A-Za-z_]\w*)\s*(?=\()"),
}
_LABEL = re.compile(r"^([A-Za-z_.$][\w.$]*):")


def functions(text: str, lang: str) -> list[tuple[str, str, int, int]]:
    """Name, kind, first and last line of each function, in order; none inside another. Assembly: from a label to the next."""
    if lang == "asm":
        lines = text.split("\n")
        heads = [(m[1], k) for k, x in enumerate(lines, 1) if (m := _LABEL.match(x)) and not m[1].startswith(".")]
        ends = [k - 1 for _, k in heads[1:]] + [len(lines)]
        return [(name, "label", k, next((e for e in range(end, k, -1) if lines[e - 1].strip()), k)) for (name, k), end in zip(heads, ends, strict=True)]
    bare, at, out = masked(text), 0, []
    line = lambda k: text.count("\n", 0, k) + 1
    head = _HEADS.get(lang)
    while head and (m := head.search(bare, at)):
        at = m.end()
        kind = "macro" if "macro" in m.re.groupindex and m["macro"] else "function"
        name = m[kind if kind == "macro" else "fn"]
        if name in KEYWORDS[lang] or (lang == "c" and re.search(r"(?:=|\breturn|[\w)]\s*\.|->)\s*$", bare[: m.start()][-40:])):
            continue
        opened = bare.find("{", at) if kind == "macro" else None
        if kind == "function":
            paren = bare.find("(", at)
            end = closing(bare, paren) if paren >= 0 else None
            # up to the body there is nothing that ends a declaration
            after = re.match(r"[^;{}=]*\{" if lang == "c" else r"[^;{}]*\{", bare[end + 1 :]) if end is not None else None
            opened = end + after.end() if after else None
        stop = closing(bare, opened) if opened is not None and opened >= 0 else None
        if stop is None:
            continue
        first = m.start() if kind == "macro" or lang == "rust" else bare.rfind("\n", 0, m.start()) + 1
        start = line(first) if lang == "c" else line(bare.rfind("\n", 0, first) + 1)
        out.append((name, kind, start, line(stop)))
        at = stop + 1
    return out


def chunks(first: int, last: int, size: int = 10) -> list[tuple[int, int]]:
    return [(k, min(last, k + size - 1)) for k in range(first, last + 1, size)]


def joined_short(ranges: list[tuple[int, int]], least: int = 4) -> list[tuple[int, int]]:
    """Ranges in order, where one shorter than least or after such a one joins the one before."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if out and min(b - a, out[-1][1] - out[-1][0]) + 1 < least:
            a, b = out[-1][0], max(out.pop()[1], b)
        out.append((a, b))
    return out


def segments(code: str, lang: str, short: int = 15) -> list[tuple[int, int]]:
    """Line ranges of a function: all of a short one; else each block of a control statement in its body, other runs of
    statements in chunks of ten, shorter ones joined. Assembly: chunks."""
    n = len(code.split("\n"))
    if n < short:
        return [(1, n)]
    bare = masked(code)
    opened = bare.find("{")
    stop = closing(bare, opened) if opened >= 0 and lang != "asm" else None
    if stop is None:
        return joined_short(chunks(1, n))
    line = lambda k: code.count("\n", 0, k) + 1
    branches, at = [], opened + 1
    word = re.compile(r"\b(?:if|else|for|while|loop|match|switch|do)\b[^;{}]*\{|[({\[]")
    while (m := word.search(bare, at, stop)):
        end = closing(bare, m.end() - 1)
        if end is None:
            break
        if len(m[0]) > 1:
            branches.append((line(m.start()), line(end)))
        at = end + 1
    out, at = list(branches), line(opened + 1) + (bare[opened + 1 :].split("\n", 1)[0].strip() == "")
    for a, b in [*branches, (line(stop), line(stop))]:
        out += chunks(at, a - 1) if a > at else []
        at = max(at, b + 1)
    return joined_short(out or chunks(1, n))

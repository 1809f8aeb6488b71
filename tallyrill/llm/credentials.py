"""Literal credentials in source code, configuration, commands, environments and headers, found and blanked.

Text is tokenized lexically into comments, strings, names, numbers and signs, whatever the language's way of writing
them; comments and strings are tokenized in turn, at any depth of quoting. A literal that is assigned or passed to a name
is flagged where the name is a credential's and the literal no placeholder, or where its own form tells (a private key,
an address with a password, a scheme with a token, a provider's token format). Blanking touches only the literal's own
characters.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of names. A name is a credential's if it ends in one of the first three lists and in none of the last.
PASSWORD_WORDS = frozenset("password passwd pwd pass passphrase passcode pw".split())
TOKEN_WORDS = frozenset("secret token credential credentials creds auth authorization apikey pat bearer jwt accesskey secretkey authtoken accesstoken".split())
SESSION_WORDS = frozenset("session sessionid sid cookie phpsessid jsessionid".split())
NAME_ENDS = ("password", "passwd", "passphrase", "apikey", "secretkey", "accesskey", "privatekey", "signingkey", "secret", "token")
OTHER_LAST = frozenset(
    "file path dir url uri endpoint host name header headers policy prefix suffix id ids ttl type kind length len size count limit max min expiry expires expiration timeout version format algorithm alg method mode enabled required"
    " public hash ref arn field param scope scopes issuer audience user username email region pattern regex label hint fingerprint digest stdin provider server service store manager rotation days tokens keys secrets passwords".split()
)
PLURALS = frozenset("tokens keys secrets passwords".split())
OTHER_FIRST = frozenset("max min num use enable enabled has is no total public".split())
OTHER_KEYS = frozenset("public primary foreign partition sort cache row group object index map dict lookup route idempotency dedupe translation registry sub press on host license".split())

# Texts that stand for a credential without being one.
_STAND_IN = re.compile(
    r"(?i)^(?:<.*>|\[.*\]|\{\{.*\}\}|\$\w+|\$\{.*\}|\$\(.*\)|`.*`|%\w+%|%\(\w+\)s|\{\w*\}|!(?:secret|env|vault|ref|sub|getatt|include|file|ssm|reference)\b.*|@\w+@|(?:none|null|nil|undefined|unset|empty|true|false|yes|no|on|off|default|disabled|todo|tbd|fixme|n/?a|secret|password|token|redacted|hidden|masked|basic|bearer|oauth2?|mtls|digest|anonymous|ldap|saml|strong|changeit|test)"
    r"|(?:vault|op|env|secret|secretref|secrets?manager|ssm|arn|aws-sm|gcp-sm|sm|akv|keyring|keychain|file|pass|doppler|infisical|sops|bw|ref|conjur|k8s|credstash|lpass)[:/].*|(?:process\.env|os\.environ|import\.meta|env|secrets)[.[].*|[a-z]:\\.*|sha(?:1|224|256|384|512)[:-].*|md5[:-].*|data:.*|ssh-(?:rsa|dss|ed25519)\s.*|ecdsa-sha2.*)$"
)
_STAND_IN_WORD = re.compile(r"(?i)(?:^|[^a-z])(?:your|insert|enter|paste|replace|change[-_ ]?me|changeme|dummy|example|sample|placeholder|redacted|masked|fake|todo|xxx+|here)(?:[^a-z]|$)")
_PATH = re.compile(r"(?:~|\.{1,2})?/[\w./${}~-]*$")
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\.\.\.|…|<[\w -]+>|\*{3,}|x{6,}|X{6,}|EXAMPLE")
_DEFAULT = re.compile(r"^\$\{\w+:?[-=]([^}]+)\}$")

# Forms of tokens that tell by themselves.
_TOKEN_FORMS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|(?:AKIA|ASIA)[0-9A-Z]{16}|[sr]k_(?:live|test)_[A-Za-z0-9]{14,}|sk-(?:proj-|svc-|ant-|live-)?[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|ya29\.[\w-]{20,}|dop_v1_[a-f0-9]{40,})(?![A-Za-z0-9])"
)
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----|\Z)", re.S)
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://([^\s:/@\"'`]*):([^\s/@\"'`]+)@")
_USER_FLAG = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user)[ =]?\\*[\"']?([^\s:\"'\\]+):([^\s\"'\\]+)")
_P_FLAG = re.compile(r"\b(?:mysql|mysqldump|mysqladmin|mysqlimport|mariadb|sshpass)\b[^\n|;&]*?\s-p(?=[^\s])\\*[\"']?([^\s\"'\\]+)")
_SCHEME = re.compile(r"(?i)^(bearer|token|basic|apikey|api-key)[ \t]+(\S+)$")

# The lexemes: comments, strings (with a language's prefix, plain or inside another string), names, numbers and signs.
_COMMENT = r"(?P<comment>(?<!\S)#[^\n]*|(?<![:\w\"'])//[^\n]*|/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z))"
_LEXEME = (
    r"(?P<string>(?:(?<!\w)[rRbBuUfF]{1,2}(?=[\"']))?(?:\"\"\"(?P<s1>.*?)\"\"\"|'''(?P<s2>.*?)'''|\"(?P<s3>(?:\\.|[^\"\\\n])*)\"|(?<!\w)'(?P<s4>(?:\\['\\]|[^'\n])*?)'|`(?P<s5>(?:\\.|[^`\\])*)`|(?P<open>\\+[\"'`])(?P<s6>[^\n]*?)(?P=open)))"
    r"|(?P<name>(?<![\w.$])[A-Za-z_][\w.\-]*)|(?P<number>(?<![\w.])\d+(?:\.\d+)?(?![\w.]))|(?P<sign>:=|=>|==|!=|<=|>=|::|[=:,(\])])"
)
_TOKEN, _IN_COMMENT = re.compile(_COMMENT + "|" + _LEXEME, re.S), re.compile(_LEXEME, re.S)
_STRING_FORMS = ("s3", "s4", "s6", "s5", "s1", "s2")  # the commonest first
_IDENT = re.compile(r"[A-Za-z_][\w.\-]*")
_TYPED = re.compile(r"[ \t]*[A-Za-z_][\w\[\]<>|. ?]*?[ \t]*=(?!=)")
_WRAP = re.compile(r"[ \t]*(?:\(?(?:\\?\r?\n)?[ \t]*(?=(?:[rbufRBUF]{1,2})?\\*[\"'`]))?")
#: What makes a value of a literal without looking it up.
_MADE = re.compile(r"(?:new[ \t]+[\w.]+|String|str|bytes|bytearray|b64decode|Buffer\.from|SecretStr|SecureString|SecretString|String\.valueOf|toCharArray|\[\]byte)[ \t]*\([ \t]*(?=\\*[\"'`])")
_MADE_STARTS = frozenset("nSsbBt[")
_JOIN, _PLUS = re.compile(r"[ \t]*(?:\+|\\)?[ \t]*(?:\r?\n)?[ \t]*(?:\+)?[ \t]*"), re.compile(r"[ \t]*(?:\r?\n[ \t]*)?\+[ \t]*(?:\r?\n[ \t]*)?")
_ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:\-]*)(?:\s[^<>]*)?>(?:<!\[CDATA\[)?(?P<text>[^<>\]]+)(?:\]\]>)?</(?P=name)\s*>")
_FLAG = re.compile(r"(?<![\w-])--?(?P<name>[A-Za-z_][\w.\-]*)[ \t]+(?P<open>\\*[\"'])?(?![-<|>&])")
_BARE = re.compile(r"[^\s\"'`,;&|)}\]]+")
_SCHEMED = re.compile(r"(?i)[ \t]*(?:bearer|basic|token|apikey)[ \t]+([^\s\"'`,;\\]+)")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?\d?[ \t]*(?:#[^\n]*)?\r?\n(?:[ \t]*\r?\n)*(?P<indent>[ \t]+)(?P<text>\S[^\r\n]*)")
# First words of calls that hand a credential over, and the fields of a pair that hold a name and its value.
SETTERS = frozenset("set with use add put update assign".split())
NAME_FIELDS, VALUE_FIELDS = frozenset("name key variable var property".split()), frozenset("value val default".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Kinds of files in which a value without quotes is an expression, no literal.
CODE_KINDS = frozenset("py ts js tsx jsx mjs java go rb rs c cc cpp cs php kt swift scala json toml".split())


@lru_cache(maxsize=65_536)
def name_kind(name: str) -> str:
    """"password", "token", "session", "key" or "" for a name that is no credential's."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in OTHER_LAST or words[0] in OTHER_FIRST or "public" in words:
        return ""
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    last = words[-1]
    if last in PASSWORD_WORDS or last.endswith(NAME_ENDS[:3]):
        return "password"
    if last in TOKEN_WORDS or last.endswith(NAME_ENDS[3:]) or (len(words) > 1 and "".join(words[-2:]) in TOKEN_WORDS):
        return "token"
    if last in SESSION_WORDS:
        return "session"
    if last == "key" and not OTHER_KEYS & set(words):
        return "token" if len(words) > 1 else "key"
    return ""


def _dense(value: str, least: int) -> bool:
    return len(value) >= least and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 7 and not re.search(r"\s", value)


def stands_in(value: str) -> bool:
    """Whether a value is a placeholder, or names a secret kept elsewhere."""
    value = value.strip()
    if not value or _STAND_IN.match(value) or _REFERENCE.search(value):
        return True
    if _PATH.match(value) and not (len(value) >= 20 and any(c.isupper() for c in value) and any(c.islower() for c in value) and any(c.isdigit() for c in value)):
        return True
    if len(set(value.lower())) <= 2 or re.fullmatch(r"[xX*.•#_\-0]+", value):
        return True
    longest = max((len(r) for r in re.findall(r"[A-Za-z0-9]+", value)), default=0)
    return bool(longest < 20 and _STAND_IN_WORD.search(value)) or len(set(re.sub(r"^[A-Za-z]{2,6}[-_](?:live[-_]|test[-_]|proj[-_])?", "", value).lower())) <= 1


def _plausible(kind: str, value: str) -> bool:
    if stands_in(value) or re.match(r"(?i)https?://|\w+://", value) or "-----BEGIN" in value:
        return False
    if kind == "password":
        return len(value) >= 5 and not re.fullmatch(r"\d{1,5}", value) and (len(value.split()) == 1 or len(value) >= 12)
    if re.search(r"\s", value):
        return False
    if kind == "token":
        return len(value) >= 8 and (any(c.isdigit() for c in value) or len(value) >= 20 or (len(value) >= 16 and value.lower() != value != value.upper())) and len(set(value)) >= 5
    return _dense(value, 16)


def _basic(value: str) -> bool:
    try:
        plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
    except ValueError:
        return False
    user, colon, password = plain.partition(":")
    return bool(colon) and len(password) >= 4 and not stands_in(password)


def _schemed(kind: str, value: str) -> tuple[int, int] | None:
    """The span of the token in a value of a scheme and a token."""
    if not (m := _SCHEME.match(value.strip())):
        return None
    shift = len(value) - len(value.lstrip())
    scheme, token = m[1].lower(), m[2]
    good = _basic(token) if scheme == "basic" else not stands_in(token) and (len(token) >= 8 if kind else _dense(token, 12))
    return (m.start(2) + shift, m.end(2) + shift) if good else None


Span = tuple[int, int, int]
"""Start, end, and where the secret begins: its start or, of a literal in several pieces, the first piece's; -1 where
a secret goes on from the piece before."""


def _shifted(spans: list[Span], by: int) -> list[Span]:
    return [(a + by, b + by, at + by if at >= 0 else at) for a, b, at in spans]


def _placed(spans: list[Span], parts: list[tuple[int, int]]) -> list[Span]:
    """Spans of the joined content of several literals as spans of the text that holds the literals."""
    placed, base = [], 0
    for a, b in parts:
        for s, e, at in spans:
            if s < base + b - a and e > base:
                begins = -1 if s < base else parts[0][0] if len(parts) > 1 else a + at
                placed.append((a + max(s - base, 0), min(a + e - base, b), begins))
        base += b - a
    return placed


def value_spans(name: str, value: str, quoted_only: bool = False) -> list[Span]:
    """Spans of the secrets in the value of a name, within the value."""
    if default := _DEFAULT.match(value):
        return _shifted(value_spans(name, default[1]), default.start(1))
    kind = name_kind(name)
    if span := _schemed(kind, value):
        return [(*span, span[0])]
    inner = text_spans(value, quoted_only)
    if inner:
        return inner
    if kind and _plausible(kind, value) and not (kind in ("session", "token") and re.search(r"[;=]\s*\w+=", value)):
        return [(0, len(value), 0)]
    if not kind and _holds_many(name) and not stands_in(value) and _dense(value, 16):
        return [(0, len(value), 0)]
    return []


@lru_cache(maxsize=65_536)
def _holds_many(name: str) -> bool:
    """Whether a name is that of several credentials, one of which only its own looks tell from a count or a path."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and words[-1] in PLURALS and words[0] not in OTHER_FIRST and not OTHER_KEYS & set(words)


Token = tuple[str, int, int, int, int]
"""Kind, start and end, and of a comment or string the start and end of what it holds."""


def tokens(text: str, in_comment: bool = False) -> list[Token]:
    """The lexemes of a text, in order; blanks and signs that bind nothing are left out. A comment holds no comments."""
    found = []
    for m in (_IN_COMMENT if in_comment else _TOKEN).finditer(text):
        kind, whole = m.lastgroup, m.span()
        if kind == "string":
            for form in _STRING_FORMS:
                inner = m.span(form)
                if inner[0] >= 0:
                    break
            found.append((kind, *whole, *inner))
        else:
            found.append((kind, *whole, *whole))
    return found


class _Bindings:
    """Literals of one text and the names they are assigned or passed to; ``spans`` holds the secrets among them."""

    def __init__(self, text: str, quoted_only: bool, hidden: list[tuple[int, int]], in_comment: bool = False):
        self.text, self.quoted_only, self.hidden = text, quoted_only, hidden
        self.tokens = tokens(text, in_comment)
        self.spans: list[Span] = []
        self.pair: tuple[str, int] | None = None  # a name given as a field's value, and where it ends
        self.used: set[int] = set()  # strings that are names or values
        self.read()
        self.enter()

    def free(self, at: int) -> bool:
        return not self.hidden or not any(s <= at < e for s, e in self.hidden)

    def blank(self, a: int, b: int) -> bool:
        return a == b or not self.text[a:b].strip(" \t")

    def read(self) -> None:
        text, all_tokens, i = self.text, self.tokens, 0
        while i < len(all_tokens):
            kind, start, end, a, b = all_tokens[i]
            i += 1
            keyed = kind == "string"
            if kind not in ("name", "string") or i >= len(all_tokens) or not self.free(start) or (keyed and not _IDENT.fullmatch(text, a, b)):
                continue
            name, at = text[a:b], i
            if keyed and text[all_tokens[at][1] : all_tokens[at][2]] == "]" and self.blank(end, all_tokens[at][1]):
                end, at = all_tokens[at][2], at + 1
            if at >= len(all_tokens) or all_tokens[at][0] != "sign" or not self.blank(end, all_tokens[at][1]):
                continue
            _, _, begin, _, _ = all_tokens[at]
            sign = text[all_tokens[at][1] : begin]
            if sign in (":=", "=>", "=", ":") or (sign == "," and keyed):
                if sign == ":" and text[begin : begin + 1] == "/":
                    continue
                if sign == ":" and not keyed and (typed := _TYPED.match(text, begin)):
                    begin = typed.end()
                if keyed:
                    self.used.add(i - 1)
                i = self.value(name, at + 1, begin, sign, keyed) or i
            elif sign == "(" and not keyed and (passed := self.passed_to(name)):
                k = at + 1
                if k + 1 < len(all_tokens) and all_tokens[k][0] == "string" and self.blank(begin, all_tokens[k][1]) and text[all_tokens[k + 1][1] : all_tokens[k + 1][2]] == ")":
                    self.literal(passed, [k])
                    i = k + 1

    @staticmethod
    def passed_to(name: str) -> str:
        """The credential's name that a call hands its argument to: that of a setter, or of a builder's step."""
        before, dot, last = name.rpartition(".")
        words = [w.lower() for w in _WORDS.findall(last)]
        if len(words) > 1 and words[0] in SETTERS:
            return last if name_kind(last) else ""
        return last if dot and name_kind(last) and words[-1] not in ("secret", "secrets", "credential", "credentials", "cookie", "session") else ""

    def at(self, place: int, k: int) -> int | None:
        """The number of the string that starts at a place, looked for from token ``k`` on."""
        while k < len(self.tokens) and self.tokens[k][1] < place:
            k += 1
        return k if k < len(self.tokens) and self.tokens[k][0] == "string" and self.tokens[k][1] == place else None

    def value(self, name: str, k: int, begin: int, sign: str, keyed: bool) -> int | None:
        """Reads the value of a name; the number of the token behind it, if it is made of literals."""
        text = self.text
        wrap = _WRAP.match(text, begin)
        first = self.at(wrap.end(), k)
        if first is None and text[wrap.end() : wrap.end() + 1] in _MADE_STARTS and (made := _MADE.match(text, wrap.end())):
            first = self.at(made.end(), k)
        if first is not None:
            parts = [first]
            gap = _JOIN if "(" in wrap[0] else _PLUS
            while (g := gap.match(text, self.tokens[parts[-1]][2])) and (more := self.at(g.end(), parts[-1] + 1)) is not None and more == parts[-1] + 1:
                parts.append(more)
            self.literal(name, parts)
            return parts[-1] + 1
        if sign == ",":
            return None
        kind = name_kind(self.named(name, begin))
        if self.quoted_only:
            while k < len(self.tokens) and self.tokens[k][1] < begin:
                k += 1
            if kind == "password" and k < len(self.tokens) and self.tokens[k][0] == "number" and self.blank(begin, self.tokens[k][1]) and self.tokens[k][2] - self.tokens[k][1] >= 6:
                self.add(self.tokens[k][1], self.tokens[k][2])
            return None
        self.bare(name, kind, begin)
        return None

    def named(self, name: str, at: int) -> str:
        """The name that a value belongs to: that of the pair it stands in, else its own."""
        return self.pair[0] if name.lower() in VALUE_FIELDS and self.pair and at - self.pair[1] < 80 else name

    def literal(self, name: str, parts: list[int]) -> None:
        spans = [self.tokens[k][3:] for k in parts]
        joined = "".join(self.text[a:b] for a, b in spans)
        self.used.update(parts)
        self.spans += _placed(value_spans(self.named(name, spans[0][0]), joined), spans)
        if name.lower() in NAME_FIELDS and _IDENT.fullmatch(joined):
            self.pair = joined, spans[-1][1]

    def add(self, a: int, b: int) -> None:
        self.spans.append((a, b, a))

    def bare(self, name: str, kind: str, begin: int) -> None:
        """A value without quotes: a block of lines, a scheme with a token, or a word."""
        text = self.text
        if block := _BLOCK.match(text, begin):
            if kind and _plausible(kind, block["text"].strip()):
                self.add(*block.span("text"))
            return
        if schemed := _SCHEMED.match(text, begin):
            token = schemed[1]
            if kind and (_basic(token) if schemed[0].lstrip()[:5].lower() == "basic" else not stands_in(token) and len(token) >= 8):
                self.add(*schemed.span(1))
            return
        start = begin
        while text[start : start + 1] in (" ", "\t"):
            start += 1
        if not (word := _BARE.match(text, start)):
            return
        if kind and _plausible(kind, word[0]) and not _ADDRESS.match(word[0]):
            self.add(*word.span())
        if name.lower() in NAME_FIELDS and _IDENT.fullmatch(word[0]):
            self.pair = word[0], word.end()

    def enter(self) -> None:
        """Reads the comments, and the strings that no name has, as texts of their own."""
        for k, (kind, _, _, a, b) in enumerate(self.tokens):
            if k in self.used or b - a <= 4 or not self.free(a):
                continue
            if kind == "comment":
                self.spans += _shifted(_Bindings(self.text[a:b], self.quoted_only, [], True).spans, a)
            elif kind == "string":
                self.spans += _shifted(text_spans(self.text[a:b]), a)
        text = self.text
        if not self.quoted_only and "-" in text:
            for m in _FLAG.finditer(text):
                kind = name_kind(m["name"])
                if kind in ("password", "token") and self.free(m.start()) and len(m["name"]) > 1:
                    end = text.find(m["open"], m.end()) if m["open"] else ((v := _BARE.match(text, m.end())) and v.end()) or -1
                    if end > 0 and _plausible(kind, text[m.end() : end]):
                        self.add(m.end(), end)


def text_spans(text: str, quoted_only: bool = False) -> list[Span]:
    """Spans of the secrets in a text of names and literals. quoted_only: values without quotes are expressions."""
    found: list[tuple[int, int]] = []  # each a secret of its own
    hidden = [(m.start(), m.end()) for m in re.finditer(r"-----BEGIN [A-Z0-9 ]*-----.*?(?:-----END [A-Z0-9 ]*-----|\Z)", text, re.S)] if "-----BEGIN" in text else []
    for m in _PRIVATE_KEY.finditer(text) if hidden else ():
        body = re.sub(r"\\+[nrt]|[\s\\\"'+]", "", m[1])
        if len(body) >= 16 and not _REFERENCE.search(body[:64]):
            found.append((m.start(), m.end()))
    if "://" in text:
        found += [m.span(2) for m in _ADDRESS.finditer(text) if not stands_in(m[2])]
    if "-u" in text or "user" in text:
        found += [m.span(2) for m in _USER_FLAG.finditer(text) if not stands_in(m[2]) and len(m[2]) >= 4]
    if " -p" in text:
        found += [m.span(1) for m in _P_FLAG.finditer(text) if not stands_in(m[1]) and len(m[1]) >= 5]
    if "</" in text:
        found += [m.span("text") for m in _ELEMENT.finditer(text) if (kind := name_kind(m["name"])) and _plausible(kind, m["text"].strip())]
    free = lambda a: not any(s <= a < e for s, e in hidden)
    for m in _TOKEN_FORMS.finditer(text):
        if free(m.start()) and not stands_in(m[0]) and (m[0][:4] in ("AKIA", "ASIA") or any(c.isdigit() for c in m[0])):
            found.append(m.span())
    spread = _Bindings(text, quoted_only, hidden).spans if _BINDS.search(text) else []
    merged: list[Span] = []
    for span in sorted({*spread, *((a, b, a) for a, b in found)}, key=lambda s: (s[0], s[2], -s[1])):
        if not merged or span[0] >= merged[-1][1]:
            merged.append(span)
    return merged


_BINDS = re.compile(r"[=:,(]|--?[A-Za-z]")
_KEPT = re.compile(r"(-----(?:BEGIN|END) [A-Z0-9 ]*-----)|(\\+(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[^\sA-Za-z0-9]|[abfnrtv0]))|(\s)|.", re.S)


def blanked(text: str, spans: list[Span]) -> str:
    """The text with the secrets' own characters written as x, and numbers without quotes as numbers; delimiters,
    escapes, line ends and key armour stay."""
    parts, at = [], 0
    for a, b, _ in spans:
        secret = text[a:b]
        if secret.isascii() and secret.isdigit() and text[a - 1 : a] not in ("'", '"', "`"):
            clean = "1" * (b - a)
        else:
            clean = _KEPT.sub(lambda m: m[0] if m[1] or m[2] or m[3] else "x", secret)
        parts += [text[at:a], clean]
        at = b
    return "".join([*parts, text[at:]])


def file_kind(kind: str | None, path: str | None) -> str:
    return (kind or "").strip().lower() or (path or "").rpartition(".")[2].lower()


@lru_cache(maxsize=50_000)
def _seen_before(name: str, value: str) -> list[Span]:
    """``value_spans`` of a short value, as the same ones come again and again."""
    return value_spans(name, value)


def find_in_values(df: DataFrame, keep: list[str], name: str, value: str) -> DataFrame:
    """(*keep, n_secrets, redacted) of each named value that holds a secret; null and empty values hold none."""
    kinds = [df.schema[k].dataType.simpleString() for k in keep]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, (_seen_before if len(v) <= 256 else value_spans)(n or "", v), v) for i, (n, v) in enumerate(zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist())) if v]
            if rows := [(i, s, v) for i, s, v in rows if s]:
                at = pa.array([i for i, _, _ in rows])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keep))), pa.array([sum(at >= 0 for *_, at in s) for _, s, _ in rows], pa.int32()), pa.array([blanked(v, s) for _, s, v in rows])], names=[*(f"_k{i}" for i in range(len(keep))), "n_secrets", "redacted"])

    slim = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), F.col(name).alias("_name"), F.col(value).alias("_value"))
    return slim.mapInArrow(find, ", ".join(f"_k{i} {t}" for i, t in enumerate(kinds)) + ", n_secrets int, redacted string").toDF(*keep, "n_secrets", "redacted")


def find_in_files(df: DataFrame, file_id: str, kind: str, path: str, content: str) -> DataFrame:
    """(file_id, lines array<bigint>, redacted) of each file that holds secrets: the line, from 1, where each begins.

    Null and empty contents hold none; files are read whole, whatever their length; of a file without a kind the
    path's ending counts. Rows don't depend on each other, so nothing is shuffled.
    """
    id_type = df.schema[file_id].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, clean = [], [], []
            for i, (k, p, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                if text and (spans := text_spans(text, file_kind(k, p) in CODE_KINDS)):
                    starts = [m.start() for m in re.finditer("\n", text)]
                    at.append(i)
                    lines.append([bisect_right(starts, at - 1) + 1 for *_, at in spans if at >= 0])
                    clean.append(blanked(text, spans))
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lines, pa.list_(pa.int64())), pa.array(clean)], names=["_id", "lines", "redacted"])

    slim = df.select(F.col(file_id).alias("_id"), F.col(kind).alias("_kind"), F.col(path).alias("_path"), F.col(content).alias("_content"))
    return slim.mapInArrow(find, f"_id {id_type}, lines array<bigint>, redacted string").withColumnRenamed("_id", file_id)

"""Problem 7: credentials inside source text, plain or under layers of encoding, and their redaction."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms of issued tokens that name their issuer (fixed values).
ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?:gh[pousr]_|npm_)[A-Za-z0-9]{20,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{16,}"
    r"|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{20,}|pypi-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{30,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|shp(?:at|ss|ca)_[A-Za-z0-9]{24,}|dop_v1_[A-Za-z0-9]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|github_pat_[A-Za-z0-9_]{20,}|ya29\.[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
ISSUED_MARKS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "glpat-", "xox", "sk-", "AIza", "eyJ", "pypi-", "hf_", "k_live_", "shp", "dop_v1_", "SG.", "github_pat_", "ya29.")
#: Words of names whose literal value is a password or secret, and those that only are one together (fixed values).
SECRET_WORDS = frozenset("password passwd passphrase passcode pwd secret apikey pass".split())
SECRET_PAIRS = frozenset(
    {"api key", "access key", "master key", "signing key", "signing salt", "private key", "private token", "auth token",
     "access token", "client secret", "encryption key", "secret key", "hmac key", "caller token", "session key", "auth key",
     "bearer token", "refresh token", "deploy key", "account key", "shared key", "cookie key", "password salt"}
)
#: Ends of names whose words nothing parts, as in environment variables.
_SECRET_ENDS = tuple(sorted({w for w in SECRET_WORDS if len(w) > 5} | {p.replace(" ", "") for p in SECRET_PAIRS}))
#: Last words that make a name speak about a secret instead of holding it (fixed values).
ABOUT = frozenset("name names id ids url uri path file field fields label hint policy length min max ttl type header prefix suffix env var ref vault store manager provider column regex pattern prompt reset page form expiry".split())
NAME_MARKS = ("passw", "passphrase", "passcode", "pwd", "secret", "key", "token", "salt", "pass")
PLACEHOLDER = re.compile(
    r"^(?:$|[x*.•#_\-?0]+$|<.*>$|\[.*\]$|\{\{?.*\}\}?$|%(?:(?:\(\w+\)|\d+\$)?[\d.]*[sdrfi]|[a-z_]\w*%|\{[\w.]+\})$|\$(?:[({$]|\d+$|(?-i:[A-Z_][A-Z0-9_]*|[a-z_][a-z0-9_]*|[a-z]+(?:[A-Z][a-z0-9]+)+|[A-Z][a-z]+(?:[A-Z][a-z0-9]+)*)$|[a-z_]\w*(?:\.|->|::|\[))|@[\w.]+@$"
    r"|(?:your|insert|enter|replace|change|todo|fixme|example|sample|dummy|default|placeholder|redacted|undefined|secret|password|passwd|hidden|removed|masked)[\W_a-z]*$"
    r"|(?:my|the|some|any|a|an|put|set|tbd|fake|test|none|null|nil|true|false|empty|token|key)(?:(?:[\W_]|pass|secret|token|key|value|here)[\W_a-z]*)?$)",
    re.I,
)
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|<%|process\.env|os\.environ|getenv|vault:|secret://|ssm:|env:|ENC\(")
#: What may stand between a name and its value, and the value; matched from the end of a name on.
ASSIGNED = re.compile(
    r"""["']?+\s*+(?::\s*+[A-Za-z_][\w<>\[\]|. ]*?)?\s*(?:=>|:=|=|:)\s*+(?:new\s++\w++\()?"""
    r"""(?P<value>"(?:[^"\\\n]|\\.)*+"(?:\s*+[+.]\s*+"(?:[^"\\\n]|\\.)*+")*+|'(?:[^'\\\n]|\\.)*+'(?:\s*+[+.]\s*+'(?:[^'\\\n]|\\.)*+')*+|`[^`\n]*+`|[^\s"'`(){}\[\],;<>]++(?=\s*(?:$|[\r\n]|\s#)))""",
    re.M,
)
NAME_CHARS = re.compile(r"[\w$.\-\]\[]*")
JOINED = re.compile(r"""(?P<value>"(?:[^"\\\n]|\\.)*+"(?:\s*+[+.]\s*+"(?:[^"\\\n]|\\.)*+")++|'(?:[^'\\\n]|\\.)*+'(?:\s*+[+.]\s*+'(?:[^'\\\n]|\\.)*+')++)""")
TAG = re.compile(r"<[A-Za-z][^<>]*+>")
TAG_NAME = re.compile(r"""\b(?:name|key|id)\s*=\s*["'](?P<name>[\w.\-]+)["']""")
TAG_VALUE = re.compile(r"""\bvalue\s*=\s*(?P<value>"[^"\n]*"|'[^'\n]*')""")
ELEMENT = re.compile(r"<(?P<name>[\w.\-]+)>(?P<value>[^<>\s]{4,})</(?P=name)>")
CALL = re.compile(r"""(?P<name>(?<![\w.\-])[\w.\-]*(?:[Pp]assword|[Ss]ecret|[Aa]pi_?[Kk]ey))["']?\s*[(,]\s*(?P<value>"(?:[^"\\\n]|\\.)+"|'(?:[^'\\\n]|\\.)+')""")
CALL_MARKS = ("password", "secret", "apikey", "api_key")
URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<user>[^\s:/@\"'`<>]*):(?P<value>[^\s/@\"'`<>]+)@[\w.\-\[\]]+")
SCHEME = re.compile(r"(?P<scheme>\b[Bb]asic|\bBASIC|\b[Bb]earer|\bBEARER)\s+(?P<value>[A-Za-z0-9+/_.=~\-]{12,})")
LOGIN = re.compile(r"\b(?:login|logon|credentials?|creds|account|sign[- ]?in)\b\s*[:=]\s*(?P<user>[\w.@\-]+)\s*(?:/|:|\s\|)\s*(?P<value>[^\s\"'<>]{6,})", re.I)
#: A login pair after a label in words, as in comments; further words may stand before the colon.
NOTED = re.compile(
    r"(?:\b(?:login|logon|credentials?|creds|accounts?|users?|sign[- ]in|Zugangsdaten|Anmeldedaten|Konto|Benutzer|cuenta|credenciales|usuario)\b"
    r"|(?:계정|접속[ \t]?정보|로그인|인증[ \t]?정보|アカウント|ログイン|接続情報|認証情報|账号|帐号|账户|登录|登陆)\w{0,4}+)"
    r"(?:[ \t]++[^\W_]++){0,5}+[ \t]*+[:=：][ \t]*+(?P<user>[\w.@\-]++)[ \t]++[/|][ \t]++(?P<value>[^\s\"'<>]{6,}+)",
    re.I,
)
LOGIN_MARKS = ("login", "logon", "cred", "account", "sign in", "sign-in", "signin")
NOTED_MARKS = (*LOGIN_MARKS, "user", "zugangsdaten", "anmeldedaten", "konto", "benutzer", "cuenta", "usuario", "계정", "정보", "로그인", "アカウント", "ログイン", "接続情報", "認証情報", "账号", "帐号", "账户", "登录", "登陆")
#: A command to its end, over lines that are continued, and its option of a login pair.
COMMAND = re.compile(r"\b(?:curl|wget)\b(?:[^\n\\]|\\(?:\r\n|(?s:.)))*+")
OPTION = re.compile(r"(?<!\S)(?:-[uU][ \t]*+|--(?:proxy-)?user(?:[ \t]++|=))[\"']?(?P<user>[^\s:\"'`]++):(?P<value>[^\s\"'`]++)")
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_LINE = re.compile(r"[A-Za-z0-9+/=]{16,}")
PUTTY = re.compile(r"PuTTY-User-Key-File-\d")
#: Encoded literals; each begins where no character of its kind comes before, so none is tried twice.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_\-=])[A-Za-z0-9+/_\-]{24,}+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40,}+(?:[ \t\\]*+\r?\n[ \t#*>]*+[A-Za-z0-9+/]{4,}+={0,2})++")
PERCENT = re.compile(r"(?<![\w.~\-+%])(?:[\w.~\-+]*+%[0-9A-Fa-f]{2}){4,}+[\w.~\-+]*+")
ESCAPED = re.compile(r"(?<![\w:/@.\-+=\\])(?:[\w:/@.\-+=]*+\\(?:x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}|[0-3][0-7]{2})){4,}+[\w:/@.\-+=]*+")
ESCAPE = re.compile(r"\\(?:x([0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|([0-3][0-7]{2}))")
HEX = re.compile(r"(?:[0-9a-f]{2}){16,}|(?:[0-9A-F]{2}){16,}")
BREAK = re.compile(r"\r\n|\n|\r")
WORDS = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    kind: str


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the element at ``at``; None where the bytes aren't one within bounds."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= end else None


def is_key_container(data: bytes) -> bool:
    """Whether bytes are a container of a private key: OpenSSH, Java key store, PKCS#1, #8, #12 or SEC 1, by their grammar."""
    if data.startswith((b"openssh-key-v1\0", b"\xfe\xed\xfe\xed\0\0\0", b"\xce\xce\xce\xce\0\0\0")):
        return True
    top = _der(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] - top[1] < 32:
        return False
    parts, at = [], top[1]
    while at < top[2]:
        part = _der(data, at, top[2])
        if not part:
            return False
        parts.append(part)
        at = part[2]
    tags = [p[0] for p in parts]
    version = int.from_bytes(data[parts[0][1] : parts[0][2]], "big") if tags[:1] == [0x02] and parts[0][2] - parts[0][1] == 1 else None
    return (
        (version in (0, 1) and len(tags) >= 9 and all(t == 0x02 for t in tags[:9]))
        or (version in (0, 1) and tags[1:3] == [0x30, 0x04])
        or (version == 1 and tags[1:2] == [0x04])
        or (version == 3 and tags[1:2] == [0x30])
        or (tags[:2] == [0x30, 0x04] and len(tags) == 2)
    )


def _literal(raw: str) -> str:
    """The text of a literal or of literals joined with a plus."""
    if raw[:1] in "\"'`":
        return "".join(re.findall(r"\"((?:[^\"\\]|\\.)*)\"" if raw[0] == '"' else r"'((?:[^'\\]|\\.)*)'" if raw[0] == "'" else r"`([^`]*)`", raw))
    return raw


@lru_cache(maxsize=50_000)
def secret_name(name: str) -> str | None:
    """``strong`` for names of passwords and secrets, ``weak`` for names of tokens and keys, else None."""
    words = [w.lower() for w in WORDS.findall(name)]
    if not words or words[-1] in ABOUT:
        return None
    if SECRET_WORDS & set(words) or words[-1].endswith(_SECRET_ENDS) or any(f"{a} {b}" in SECRET_PAIRS for a, b in zip(words, words[1:], strict=False)):
        return "strong"
    return "weak" if words[-1] in ("token", "key", "salt", "auth", "credential", "credentials") else None


def _random_looking(v: str) -> bool:
    return len(v) >= 16 and re.fullmatch(r"[A-Za-z0-9_\-.+/=~]+", v) is not None and (
        re.fullmatch(r"[0-9a-fA-F]{24,}", v) is not None or (sum(c.isdigit() for c in v) >= 3 and len(re.findall(r"[a-z](?=[A-Z0-9])|[0-9](?=[A-Za-z])", v)) >= 5)
    )


def _mixed_letters(v: str) -> bool:
    """Letters whose case changes too often for words joined in camel case."""
    pieces = WORDS.findall(v)
    return len(v) >= 8 and v.isascii() and v.isalpha() and len(pieces) >= 4 and len(v) <= 3 * len(pieces)


def _password_like(v: str) -> bool:
    """A value that neither words, numbers, dates nor paths make up."""
    return _mixed_letters(v) or (
        re.search(r"[A-Za-z]", v) is not None and re.search(r"[\d\W_]", v) is not None and re.fullmatch(r"[A-Za-z]+(?:[._/-][A-Za-z]+)*[.,:;!?)]*", v) is None and not v.startswith(("/", "./", "http://", "https://", "--"))
    )


def secret_value(v: str, strength: str, quoted: bool) -> bool:
    v = v.strip()
    if len(v) < 6 or PLACEHOLDER.match(v) or REFERENCE.search(v) or len(set(v)) < 4:
        return False
    if strength == "weak":
        return _random_looking(v)
    if re.search(r"\s", v) and quoted:
        return False
    if re.fullmatch(r"[\d.,:%]+", v) or v.startswith(("/", "./", "http://", "https://", "--")):
        return False
    if not quoted and (re.search(r"[(\[]", v) or re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+;?", v) or re.fullmatch(r"[a-z]+(?:[_-][a-z]+)*", v)):
        return False
    return _mixed_letters(v) or (bool(re.search(r"[\d\W_]", v)) and re.fullmatch(r"[a-z]+(?:[._-][a-z]+)*", v) is None)


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    """Where keys in PEM begin and end in this text: at the footer before the next header, else with the last line of
    the body. A header without a body is none, unless the text ends there."""
    headers, footers = list(PEM.finditer(text)), list(PEM_END.finditer(text))
    at = [f.start() for f in footers]
    for i, m in enumerate(headers):
        limit = headers[i + 1].start() if i + 1 < len(headers) else len(text)
        n = bisect_left(at, m.end())
        footer = footers[n] if n < len(at) and at[n] < limit else None
        stop = footer.start() if footer else limit
        body = text[m.end() : stop].replace("\\n", "\n").replace("\\r", "")
        if not PEM_LINE.search(body):
            if not footer and limit == len(text) and not re.search(r"[A-Za-z0-9]", body):
                yield m.start(), m.end()
        elif footer:
            yield m.start(), footer.end()
        else:
            end = m.end()
            for line in PEM_LINE.finditer(text, m.end(), stop):
                if line.start() - end > 40:
                    break
                end = line.end()
            yield m.start(), end


def _lower(text: str) -> str:
    """Lower case at the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _secret_names(text: str, low: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, strength) of each name in the text that speaks of a secret.

    Marks are looked up first and the name is walked out from them; a mark inside a name already taken is passed over, so
    no character is walked twice.
    """
    found = set()
    for mark in NAME_MARKS:
        at = low.find(mark)
        while at >= 0:
            found.add(at)
            at = low.find(mark, at + len(mark))
    done = 0
    for at in sorted(found):
        if at < done:
            continue
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_$.-[]"):
            start -= 1
        done = NAME_CHARS.match(text, at).end()
        end = done
        while end > at and not (text[end - 1].isalnum() or text[end - 1] in "_]"):
            end -= 1
        strength = secret_name(text[start:end])
        if strength:
            yield start, end, strength


def _plain(text: str) -> list[Finding]:
    found: list[Finding] = []
    if any(m in text for m in ISSUED_MARKS):
        found += [Finding(m.start(), m.end(), "token") for m in ISSUED.finditer(text) if len(set(m.group())) > 8]
    if "PRIVATE KEY" in text or "PuTTY-User" in text:
        found += [Finding(a, b, "private_key") for a, b in _private_keys(text)]
        found += [Finding(m.start(), m.end(), "private_key") for m in PUTTY.finditer(text)]
    if "://" in text and "@" in text:
        for m in URL.finditer(text):
            v = m.group("value")
            if not PLACEHOLDER.match(v) and not REFERENCE.search(m.group()) and not re.search(r"[${}<>*]{2}|^\$", v):
                found.append(Finding(m.start("value"), m.end("value"), "login"))
    low = _lower(text)
    if "basic " in low or "bearer " in low:
        for m in SCHEME.finditer(text):
            v = m.group("value")
            if m.group("scheme").lower() == "basic":
                try:
                    pair = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
                except (ValueError, UnicodeDecodeError):
                    continue
                user, colon, word = pair.partition(":")
                if colon and user and word and pair.isprintable() and not PLACEHOLDER.match(word) and not REFERENCE.search(word):
                    found.append(Finding(m.start("value"), m.end("value"), "login"))
            elif _random_looking(v):
                found.append(Finding(m.start("value"), m.end("value"), "token"))
    if any(x in low for x in LOGIN_MARKS):
        for m in LOGIN.finditer(text):
            v = m.group("value")
            if not PLACEHOLDER.match(v) and not REFERENCE.search(v) and re.search(r"[\d\W_]", v) and not re.fullmatch(r"[a-z]+(?:[._/-][a-z]+)*", v):
                found.append(Finding(m.start("value"), m.end("value"), "login"))
    if any(x in low for x in NOTED_MARKS):
        for m in NOTED.finditer(text):
            v = m.group("value")
            if not PLACEHOLDER.match(v) and not REFERENCE.search(v) and _password_like(v):
                found.append(Finding(m.start("value"), m.end("value"), "login"))
    if "curl" in low or "wget" in low:
        for command in COMMAND.finditer(text):
            for m in OPTION.finditer(text, command.start(), command.end()):
                v = m.group("value")
                if len(v) >= 4 and not PLACEHOLDER.match(v) and not REFERENCE.search(v):
                    found.append(Finding(m.start("value"), m.end("value"), "login"))
    for start, end, strength in _secret_names(text, low):
        m = ASSIGNED.match(text, end)
        if m:
            found += _judged(m, strength, text, False)
        elif text[end : end + 1] == ">" and text[start - 1 : start] == "<":
            m = ELEMENT.match(text, start - 1)
            if m:
                found += _judged(m, strength, text, True)
    if "<" in text and "value" in low:
        for tag in TAG.finditer(text):
            name, value = TAG_NAME.search(text, tag.start(), tag.end()), TAG_VALUE.search(text, tag.start(), tag.end())
            if name and value and (strength := secret_name(name.group("name"))):
                found += _judged(value, strength, text, False)
    if any(m in low for m in CALL_MARKS):
        for m in CALL.finditer(text):
            if strength := secret_name(m.group("name")):
                found += _judged(m, strength, text, False)
    if '" +' in text or "' +" in text or '"+' in text or "'+" in text:
        for m in JOINED.finditer(text):
            if ISSUED.fullmatch(_literal(m.group("value"))):
                found.append(Finding(m.start("value") + 1, m.end("value") - 1, "token"))
    return found


def _judged(m: re.Match, strength: str, text: str, element: bool) -> list[Finding]:
    """The value of a match as a finding, if it is a secret's."""
    raw = m.group("value")
    quoted = raw[:1] in "\"'`"
    value = _literal(raw)
    if ISSUED.fullmatch(value) or (secret_value(value, strength, quoted or element) and not _is_sentence(text, m)):
        shift = 1 if quoted else 0
        return [Finding(m.start("value") + shift, m.end("value") - shift, "password" if strength == "strong" else "key")]
    return []


def _is_sentence(text: str, m: re.Match) -> bool:
    """A value of several words is prose, not a secret."""
    return len(m.group("value").split()) > 3 and '" +' not in m.group("value")


def _layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, bytes) of each encoded literal of a text: hex, base64 (also wrapped over lines), percent, escapes."""
    wrapped = 0
    for m in BASE64.finditer(text):
        raw = m.group()
        if HEX.fullmatch(raw):
            yield m.start(), m.end(), binascii.unhexlify(raw)
            continue
        yield from _base64(m.start(), m.end(), raw)
        if len(raw) >= 40 and m.start() >= wrapped and (lines := WRAPPED.match(text, m.start())):
            wrapped = lines.end()
            yield from _base64(lines.start(), wrapped, re.sub(r"[\s\\#*>]+", "", lines.group()))
    if "%" in text:
        for m in PERCENT.finditer(text):
            yield m.start(), m.end(), unquote_to_bytes(m.group())
    if "\\" in text and ESCAPE.search(text):
        for m in ESCAPED.finditer(text):
            plain = ESCAPE.sub(lambda e: chr(int(e[1] or e[2], 16) if e[1] or e[2] else int(e[3], 8)), m.group())
            yield m.start(), m.end(), plain.encode("utf-8", "ignore")


def _base64(start: int, end: int, raw: str) -> Iterator[tuple[int, int, bytes]]:
    body = raw.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            yield start, end, base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        except (ValueError, binascii.Error):
            pass


def _as_text(data: bytes) -> str | None:
    """Decoded bytes as printable text, in UTF-8 or, where every other byte is NUL, UTF-16."""
    codec = "utf-8"
    if b"\0" in data:
        if len(data) % 2 or max(data[::2].count(0), data[1::2].count(0)) < len(data) // 4:
            return None
        codec = "utf-16-le" if data[1::2].count(0) >= data[::2].count(0) else "utf-16-be"
    try:
        text = data.decode(codec)
    except UnicodeDecodeError:
        return None
    return text if text.translate(_BREAKS).isprintable() else None


_BREAKS = str.maketrans("", "", "\r\n\t\ufeff")


def find_credentials(text: str) -> list[Finding]:
    """Credentials of a text in order, merged where they overlap; of encoded ones the whole enclosing literal.

    Each layer is decoded, parsed as a key container by its grammar, or scanned again as text; a layer is shorter than
    the literal around it, so the descent ends without a limit.
    """
    found = _plain(text)
    for start, end, data in _layers(text):
        if not 12 <= len(data) < end - start:
            continue
        if is_key_container(data):
            found.append(Finding(start, end, "private_key"))
        elif (inner := _as_text(data)) is not None and (kinds := find_credentials(inner)):
            found.append(Finding(start, end, kinds[0].kind))
    found.sort(key=lambda f: (f.start, -f.end))
    out: list[Finding] = []
    for f in found:
        if out and f.start < out[-1].end:
            if f.end > out[-1].end:
                out[-1] = Finding(out[-1].start, f.end, out[-1].kind)
        else:
            out.append(f)
    return out


def redact(text: str, findings: list[Finding]) -> str:
    """``text`` with the characters of each finding put out, at the same length.

    Letters and digits become ``x``; quotes, line breaks, comment marks and plus signs between the parts of a literal
    stay where they are, and so do the header and footer of a key, so the code around still parses.
    """
    out, at = [], 0
    for f in findings:
        out.append(text[at : f.start])
        part, done = text[f.start : f.end], 0
        for keep in re.finditer(r"-----(?:BEGIN|END)[^\n]*?-----|\\[nr]|\"\s*[+.]?\s*\"|'\s*[+.]?\s*'", part):
            out.append(re.sub(r"[^\s\"'`\\#>*\-+]", "x", part[done : keep.start()]) + keep.group())
            done = keep.end()
        out.append(re.sub(r"[^\s\"'`\\#>*+\-]", "x", part[done:]) if f.kind == "private_key" else re.sub(r"[^\s\"'`\\]", "x", part[done:]))
        at = f.end
    out.append(text[at:])
    return "".join(out)


def _scan(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk_id, first, text in zip(pdf["chunk_id"], pdf["start_line"], pdf["text"], strict=True):
                findings = find_credentials(text)
                if not findings:
                    continue
                starts = [m.end() for m in BREAK.finditer(text)]
                clean = redact(text, findings) if with_text else None
                for f in findings:
                    rows.append((chunk_id, int(first) + bisect_right(starts, f.start), f.start, f.end, f.kind, clean))
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "char_start", "char_end", "kind", "redacted"])

    return run


def credentials(code_chunks: DataFrame, with_text: bool = False) -> DataFrame:
    """(chunk_id, line_no, char_start, char_end, kind, redacted): each credential of each chunk, without repetitions.

    ``line_no`` counts in the file from the chunk's ``start_line`` (1 where null); a CRLF is one break; ``char_start``
    and ``char_end`` count in the chunk. With ``with_text`` the chunk's text comes along, every credential in it put
    out. Null and empty texts and null ids give nothing. A chunk is scanned alone in its partition and whole, so
    nothing is shuffled but the findings.
    """
    rows = code_chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > 0)).select(
        "chunk_id", F.coalesce(F.col("start_line"), F.lit(1)).cast("long").alias("start_line"), "text"
    )
    return rows.mapInPandas(
        _scan(with_text), "chunk_id string, line_no long, char_start int, char_end int, kind string, redacted string"
    ).distinct()

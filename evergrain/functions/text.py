"""Text scanners as Columns: redaction, leaks, injections, entropy, corrections, keys, sanitising and scrub rules.

Patterns are written once and mean what they mean in Python's `re` for str: \\w, \\s and \\b are Unicode (letters, numbers and the
underscore; white space and the separators 1C to 1F), ignoring case folds beyond ASCII, and a line ends at a line feed only.
_u() states that in Java's terms.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------------------------------

SECRET_KEY = (
    r"(?:(?i:(?:[a-z0-9]+[_-])*(?:api[_-]?key|secret[_-]?key|private[_-]?key|token|secret|passwd|password|credentials?|authorization))"
    r"|(?:[A-Za-z0-9]*(?:ApiKey|SecretKey|PrivateKey|AccessToken|RefreshToken|AuthToken|BearerToken|ClientSecret|ClientPassword|Token|Secret|Password|Credential|Credentials|Authorization)))"
)
PEM = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"

#: In this order: what one rule leaves the next one sees.
REDACTIONS = (
    (PEM, "[REDACTED_PRIVATE_KEY]"),
    (JWT, "[REDACTED_JWT]"),
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{16,}", "$1[REDACTED]"),
    (r"sk-[A-Za-z0-9_-]{16,}", "[REDACTED]"),
    (r"ghp_[A-Za-z0-9_]{20,}", "[REDACTED]"),
    (r"github_pat_[A-Za-z0-9_]{20,}", "[REDACTED]"),
    (r"xox[baprs]-[A-Za-z0-9-]{20,}", "[REDACTED]"),
    (rf'(\\?"{SECRET_KEY}\\?"\s*:\s*\\?")([^"]*?)(\\?")', "$1[REDACTED]$3"),
    (rf"\b({SECRET_KEY}\s*[:=]\s*)(\"[^\"\n]+\"|'[^'\n]+')", '$1"[REDACTED]"'),
    (rf"({SECRET_KEY})(\s*[:=]\s*)([^\s\"']+)", "$1$2[REDACTED]"),
)
LEAKS = (
    ("openai_key", r"sk-[A-Za-z0-9_-]{16,}"),
    ("github_token", r"(?:ghp_|github_pat_)[A-Za-z0-9_]{20,}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]{20,}"),
    ("bearer_token", r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("jwt", JWT),
    ("private_key", PEM),
    ("json_quoted_secret", rf'\\?"{SECRET_KEY}\\?"\s*:\s*\\?"(?!\[REDACTED\])[^"]+?\\?"'),
    ("assigned_secret", rf"{SECRET_KEY}\s*[:=]\s*(?!\[REDACTED\])(?!\"\[REDACTED\]\")(?!'\[REDACTED\]')[^\s]+"),
)
INJECTIONS = (
    ("ignore_previous", r"(?i)\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|preceding|all)\b[^.\n]{0,20}\b(instruction|instructions|prompt|prompts|context|rules?|directions?)\b"),
    ("role_hijack", r"(?i)(\byou are now\b|\bact as\b|\bpretend to be\b|\bpretend you\b|\bfrom now on you\b|\bnew (system )?instructions?\s*:|^\s*system\s*:|\bdisregard your (persona|role|guidelines)\b)"),
    ("tool_coax", r"(?i)(\brun the following\b|\bexecute (this|the following)\b|\b(call|invoke|use) the [\w.\-]+ tool\b|\bcurl\s+https?://|\brm\s+-rf\b|\bsend (them|it|the) (to|contents)\b)"),
    ("exfil_link", r"(?i)(!\[[^\]]*\]\(https?://|https?://[^\s)]+\?[^\s)]*=[^\s)]{6,})"),
    ("base64_blob", r"[A-Za-z0-9+/]{200,}={0,2}"),
    ("invisible_chars", r"[\u200B-\u200F\u202A-\u202E\u2066-\u2069\uFEFF]"),
    ("prompt_leak_probe", r"(?i)(\brepeat (the )?(words|text|everything)\b[^.\n]{0,20}\babove\b|\b(print|reveal|show|expose|leak)\b[^.\n]{0,30}\b(system prompt|your (instructions|prompt|rules)|initial prompt)\b|\bwhat (are|were) your (instructions|initial instructions)\b)"),
)
ENTROPY_RUN = r"([A-Za-z0-9+/=_-]{40,}|\b[0-9a-fA-F]{40,}\b)"
AFFIRMATION = r"(?i)\b(thanks|thank you|thx|perfect|great|nice|love it|ship it|beautiful|lgtm|awesome|exactly right|looks good|works|wonderful)\b"
CORRECTION_CUES = (
    (r"(?i)\b(that'?s |it'?s )?(wrong|incorrect|not right|not correct)\b", 0.6),
    (r"(?i)\b(that'?s not|not what i|didn'?t (ask|want)|that isn'?t)\b", 0.5),
    (r"(?i)\b(should( not| n'?t)? be|shouldn'?t|supposed to be|misunderstood)\b", 0.4),
    (r"(?i)\b(revert|undo|roll ?back|the mistake|you broke)\b", 0.4),
    (r"(?i)\bactually\b", 0.3),
    (r"(?i)\b(instead|rather)\b", 0.3),
    (r"(?i)\b(don'?t|do not|stop|never|no longer)\b", 0.3),
    (r"(?i)\b(fix|redo|try again|correct(ion)?)\b", 0.3),
    (r"(?i)^\s*(no,|nope\b|no\b)", 0.3),
    (r"(?i)\bit'?s (actually|not|really|supposed|meant to be)\b", 0.3),
    (r"(?i)\byou (said|wrote|put|typed|had|called it|listed|meant)\b", 0.3),
    (r"(?i)\bshould (say|read|use|return|point|have|go|include|match|show)\b", 0.4),
)
FTS_STOPWORDS = (
    "about", "after", "again", "also", "and", "are", "can", "could", "for", "from", "have", "how", "into", "just", "make", "our", "should",
    "that", "the", "their", "them", "then", "this", "very", "was", "were", "what", "when", "where", "which", "with", "would", "your",
)
NEGATIONS = ("no", "not", "never", "without", "cannot", "can't", "doesn't", "isn't")
STOP_TERMS = (
    "and", "are", "for", "from", "has", "into", "must", "not", "the", "that", "this", "uses", "with", "what", "how", "why", "when", "where",
    "who", "which", "does", "did", "should", "could", "would", "about", "current", "is", "it", "its", "my", "your",
)

REFUSAL = r"(?i)^\W*(i'?m sorry|i am sorry|i apologi[sz]e|sorry[,.]|i can'?t (?:help|assist|do|comply|provide)|i cannot (?:help|assist|do|comply|provide)|i'?m (?:not able|unable) to|i am (?:not able|unable) to|as an ai|unfortunately,? i (?:can'?t|cannot))"
MANAGED_BLOCK = r"(?i)(BEGIN|END) [A-Z0-9_]+ MANAGED BLOCK"
ENVELOPE = r"(?i)(?:Conversation info|Sender|Replied message) \(untrusted(?: metadata)?(?:, for context)?\)"
TRANSPORT = r"(?is)(?:\"content\"\s*:\s*\"\s*\[\[\s*reply_to_current\s*\]\]|system\s*\(untrusted\)\s*:|<goal_context\b|</goal_context\s*>|<<<\s*(?:BEGIN|END)_[A-Z0-9]+_INTERNAL_CONTEXT\s*>>>|<task-notification\b|<environment_context\b|pre-compaction memory flush\b|\[cron:[^\]]+\]|read\s+HEARTBEAT\.md\b|a new session was started via /new or /reset\b|warning:\s*(?:the maximum number of unified exec processes|apply_patch was requested|you have \d+ weighted tokens left))"
TRACEBACK = r"Traceback \(most recent call last\)"
STACK_LINE = r"(?m)^\s*File \".*\", line \d+"
REPLY_PREFIX = r"(?i)\A(?:\s*\[\[\s*reply_to_current\s*\]\]\s*)+"
UNTRUSTED_BLOCK = r"(?ims)^[ \t]*(?:Conversation info|Sender|Replied message)\s*\(untrusted(?: metadata)?(?:,\s*for context)?\):[ \t]*\n```(?:json)?[ \t]*\n.*?^```[ \t]*(?:\n|\z)"
EMAIL = r"(?i)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}(?![\w-])"
PHONE = r"(?<![\w])(?:\+?1[ ./-]?)?\(?\d{3}\)?[ ./-]\d{3}[ ./-]\d{4}(?![\w])"
LABELLED_ID = r"(?i)\b(sender[_ -]?id|message[_ -]?id|chat[_ -]?id|conversation[_ -]?id|context[_ -]?id|telegram[_ -]?id|broker(?:age)?[_ -]?(?:account|acct)(?:[_ -]?(?:id|number|no\.?))?|account[_ -]?(?:id|number|no\.?))([\"']?\s*[:=#-]\s*[\"']?)([A-Z0-9][A-Z0-9_.@+-]{3,})"
ACCOUNT_VALUE = r"(?i)\b((?:broker(?:age)?\s+)?account)(\s+)`?((?=[A-Z0-9-]{0,24}\d)[A-Z0-9][A-Z0-9-]{5,})`?"
BLOCKED = r"(?im)^\s*(?:#{1,6}\s*)?(?:\*\*)?BLOCKED\b"
ACKNOWLEDGED = r"(?i)^\s*(?:got it|understood|on it|will do|okay|ok(?:ay)?|sounds good|agreed|acknowledged|thanks|thank you|yes)[.!,:;\s-]+"
HEARTBEAT = r"(?i)\b(?:handled (?:the )?heartbeat|heartbeat (?:task )?(?:handled|recorded)|notify\s*=\s*false|no user notification (?:is )?needed|no visible heartbeat notification (?:was )?sent|no unfinished tasks?|nothing needs (?:the )?user'?s attention)\b"
INTENT = (
    r"(?im)(?:\bi(?:'|’)m\s+(?:now\s+|actively\s+|still\s+)?(?:checking|inspecting|implementing|adding|updating|running|rerunning|starting|tracing|locating|patching|finishing|testing|applying|pulling|reviewing|rebuilding|deploying|editing|doing|taking|working|staying|pushing|watching|waiting)"
    r"|\b(?:i\s+am|i(?:'|’)m)\s+going\s+to|\bi(?:'|’)ll\s+(?:check|inspect|implement|add|update|run|start|trace|locate|patch|finish|test|apply|pull|review|keep|continue|work|watch|wait|back\s+up|rebuild|deploy|edit|surface)"
    r"|\blet\s+me\s+(?:check|inspect|run|trace|locate|patch|review)|\bnext\s+(?:i(?:'|’)ll|i\s+will)|^\s*(?:launching|checking|inspecting|implementing|updating|running|starting|tracing|patching|testing|pulling)\b)"
)
VERIFIED = r"(?i)\b(?:verified|confirmed|double-checked|fresh (?:live )?check|current state|proof (?:shows|is|was)|(?:preflight|checks?) (?:is |are )?(?:clean|green|pass(?:ed)?)|[a-z_-]+ path pass(?:es|ed)|tests? passed|exit(?: code)?\s*0)\b"
CONCRETE = (
    r"(?i)(?:\b\d+[\s,]*(?:/\s*\d+|tests?|checks?|files?|rows?|items?|calls?|errors?|failures?|jobs?|processes?|submissions?|passed|failed|%)\b"
    r"|\b(?:run|job|build|task|ticket|commit|pid|status)\s*(?:id\s*)?[:#=-]\s*[A-Z0-9][A-Z0-9_.-]{2,}\b|\b[A-Z_][A-Z0-9_.-]*\s*=\s*\d+(?:\.\d+)?\b|`[0-9a-f]{7,40}`"
    r"|\b(?:tests?\s+passed|[a-z_-]+\s+path\s+pass(?:es|ed)|deployed|shipped|merged|committed|completed|resolved|running|healthy|green|clean|failed|failure|no\s+live\s+submissions?|zero\s+(?:errors?|failures?|submissions?))\b)"
)
JUDGMENT = r"(?i)\b(?:because|therefore|which means|so (?:the|this|we|i)|i (?:recommend|will|won'?t)|next\s*:|the (?:right|safe|honest) (?:move|step|call)|should|must|safe|unsafe|honest|dishonest|fail(?:s)? closed|table stakes|wrong)\b"
CHANGED = r"(?i)\b(?:the (?:code-side )?fix is in|i (?:fixed|implemented|added|removed|updated)|is implemented|now (?:prefers|uses|rejects|requires)|is set to)\b"
TOOL_ERROR = r"(?i)(?:^|\b)(?:error|traceback \(most recent call last\)|exception|assertionerror|command failed|failed with|exit code [1-9]|non-zero exit|fatal:|permission denied|no such file|✕|✗)\b"
MEDIA_ONLY = r"(?i)^(?:\[(?:image|images?\s*#?\d*|photo|voice message|audio|video|file|document|attachment|sticker|gif)\s*[^\]]*\]|<media[^>]*>)\s*$"
MIN_TARGET, MAX_EXAMPLE = 40, 32000

# ---- Scanners -----------------------------------------------------------------------------------------------------


#: Python's classes in Java's terms: what stands inside brackets, and how each escape is said outside of them.
_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f"
_ESCAPES = {
    "w": f"[{_WORD}]", "W": f"[^{_WORD}]", "s": f"[{_SPACE}]", "S": f"[^{_SPACE}]",
    "b": f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))",
}
_IN_BRACKETS = {"w": _WORD, "s": _SPACE}


@cache
def _u(pattern: str) -> str:
    """The pattern for Java, with Python's classes, case folding and line ends."""
    out, inside, i = ["(?Ud)"], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            known = _IN_BRACKETS if inside else _ESCAPES
            out.append(known.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        i += 1
    return "".join(out)


#: The same for other modules' patterns.
java_pattern = _u

#: Classes as SQL's engines (RE2) have them: ASCII only, \\b between ASCII letters whatever the case folding.
_ASCII_WORD, _ASCII_SPACE = "A-Za-z0-9_", r"\t\n\f\r "
_ASCII_ESCAPES = {
    "w": f"[{_ASCII_WORD}]", "W": f"[^{_ASCII_WORD}]", "s": f"[{_ASCII_SPACE}]", "S": f"[^{_ASCII_SPACE}]",
    "b": f"(?:(?<![{_ASCII_WORD}])(?=[{_ASCII_WORD}])|(?<=[{_ASCII_WORD}])(?![{_ASCII_WORD}]))",
}


@cache
def sql_pattern(pattern: str) -> str:
    """The pattern for Java as SQL's engines read it. For patterns without brackets: letters that fold to s and k are the only ones beyond ASCII."""
    out, i = ["(?d)"], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(_ASCII_ESCAPES.get(pattern[i + 1], pattern[i : i + 2]))
            i += 2
            continue
        out.append({"s": "[s\u017f]", "k": "[k\u212a]"}.get(c, c))
        i += 1
    return "".join(out)


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(_u(pattern)), F.lit(False))


#: One of these words must be in a text for a slow pattern to match at all; a text without them skips the pattern. They are
#: looked for in the folded text (lower case, with the four letters beyond ASCII that fold to ASCII ones), or where the
#: pattern minds case, in the text as it is.
SECRET_WORDS = ("key", "token", "secret", "passw", "credential", "authorization")
NEEDED = {
    "bearer_token": ("bearer",), "json_quoted_secret": SECRET_WORDS, "assigned_secret": SECRET_WORDS,
    "ignore_previous": ("instruction", "prompt", "context", "rule", "direction"),
    "role_hijack": ("you are now", "act as", "pretend", "from now on you", "instruction", "system", "disregard your"),
    "tool_coax": ("run the following", "execute th", " tool", "curl", "-rf", "send "),
    "exfil_link": ("http",), "prompt_leak_probe": ("above", "prompt", "instruction", "rule"),
}
NEEDED_AS_IS = {"openai_key": ("sk-",), "github_token": ("ghp_", "github_pat_"), "slack_token": ("xox",), "jwt": ("eyJ",), "private_key": ("-----BEGIN ",)}


#: The same for the rules of cleaning, scrubbing and chatter, by pattern.
UNTRUSTED = ("(untrusted",)
NEEDED_OF = {
    UNTRUSTED_BLOCK: UNTRUSTED, ENVELOPE: UNTRUSTED, EMAIL: ("@",), ACCOUNT_VALUE: ("account",), MANAGED_BLOCK: (" managed block",), BLOCKED: ("blocked",),
    LABELLED_ID: ("sender", "message", "chat", "conversation", "context", "telegram", "broker", "account"),
    TRANSPORT: (
        "reply_to_current", "(untrusted", "goal_context", "_internal_context", "<task-notification", "<environment_context", "pre-compaction memory flush", "[cron:", "heartbeat.md",
        "a new session was started via", "warning:",
    ),
    HEARTBEAT: ("heartbeat", "notify", "no user notification", "unfinished task", "nothing needs"),
    INTENT: (
        "'m", "\u2019m", "'ll", "\u2019ll", "going", "next", "launching", "checking", "inspecting", "implementing", "updating", "running", "starting", "tracing", "patching", "testing", "pulling",
    ),
}
#: A part of every phone number, looked for first: it starts nowhere but at a digit.
PHONE_PART = r"\d{3}[ ./-]\d{4}"
#: The same of a secret's name with its sign, and of what an intent may begin with.
SECRET_PART = r"(?:key|token|secret|passwd|password|credentials?|authorization)\\?\"?\s*[:=]"
LET_ME = r"let\s+me"


def folded(text: Column) -> Column:
    """Lower case in which every letter that a pattern takes for an ASCII one is that letter."""
    return F.lower(F.when(_any_of(text, ("\u017f", "\u212a", "\u0131", "\u0130")), F.translate(text, "\u017f\u212a\u0131\u0130", "skii")).otherwise(text))


def _any_of(text: Column, words: tuple[str, ...]) -> Column:
    found = text.contains(words[0])
    for w in words[1:]:
        found = found | text.contains(w)
    return found


def _names(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Names of the patterns that fire; the text is folded once."""
    return _once(_both(text), lambda x: _named(x["raw"], x["low"], rules))


def _named(raw: Column, low: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    def fires(name: str, pattern: str) -> Column:
        found = raw.rlike(_u(pattern))
        if SECRET_KEY in pattern:
            found = low.rlike(_u(SECRET_PART)) & found
        if name in NEEDED:
            return _any_of(low, NEEDED[name]) & found
        return _any_of(raw, NEEDED_AS_IS[name]) & found if name in NEEDED_AS_IS else found

    return F.array_compact(F.array(*[F.when(F.coalesce(fires(n, p), F.lit(False)), F.lit(n)) for n, p in rules]))


def _both(text: Column) -> Column:
    """The text and the folded text, once each."""
    return _once(text, lambda t: F.struct(t.alias("raw"), folded(t).alias("low")))


def _may(low: Column, pattern: str) -> Column:
    """Whether a folded text has what the pattern needs."""
    return _any_of(low, NEEDED_OF[pattern])


def _replaced(text: Column, needed: Column, pattern: str, put: str) -> Column:
    """The pattern replaced where what it needs is there."""
    return _once(text, lambda t: F.when(needed, F.regexp_replace(t, _u(pattern), put)).otherwise(t))


def _once(value: Column, rule) -> Column:
    """rule(value), with value worked out once however often the rule looks at it."""
    return F.element_at(F.transform(F.array(value), rule), 1)


def redact_secrets(text: Column) -> Column:
    return _once(_both(text), lambda x: _redacted(x["raw"], x["raw"], x["low"]))


#: What each of REDACTIONS needs: a word of the folded text, or one of the text as it is.
_REDACTIONS_NEED = (*(NEEDED_AS_IS[k] for k in ("private_key", "jwt")), ("bearer",), ("sk-",), ("ghp_",), ("github_pat_",), ("xox",), *[SECRET_WORDS] * 3)


def _redacted(text: Column, raw: Column, low: Column) -> Column:
    """text, of which raw is an earlier state and low that one folded. No rule makes a word that another one needs: what is put in stands in brackets."""
    for (pattern, put), words in zip(REDACTIONS[:-3], _REDACTIONS_NEED[:-3], strict=True):
        text = _replaced(text, _any_of(low if pattern.startswith("(?i)") else raw, words), pattern, put)
    # a secret's name and its sign may come together where a block between them went, so they are looked for in what is left
    named = lambda t: _once(t, lambda u: F.when(folded(u).rlike(_u(SECRET_PART)), _secrets(u)).otherwise(u))
    return _once(text, lambda t: F.when(_any_of(low, SECRET_WORDS), named(t)).otherwise(t))


def _secrets(text: Column) -> Column:
    for pattern, put in REDACTIONS[-3:]:
        text = F.regexp_replace(text, _u(pattern), put)
    return text


def secret_leaks(text: Column) -> Column:
    """Names of the leak patterns that fire, in their order."""
    return _names(text, LEAKS)


def injections(text: Column) -> Column:
    """Names of the injection patterns that fire, in their order."""
    return _names(text, INJECTIONS)


def shannon_entropy(text: Column) -> Column:
    """Bits a character; 0 for an empty text."""
    signs = F.split(text, "")
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda s: s == c)) / n)
    return F.when(F.length(text) > 0, -F.aggregate(each, F.lit(0.0), lambda a, p: a + p * F.log2(p))).otherwise(F.lit(0.0))


def entropy_spans(text: Column, min_length: int = 40, min_entropy: float = 3.5) -> Column:
    # the second form of ENTROPY_RUN is the first one's too, which is tried before it at each place
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9+/=_-]{40,}+)"), 1)
    return F.filter(found, lambda s: (F.length(s) >= min_length) & (shannon_entropy(s) >= min_entropy))


def is_affirmation(text: Column) -> Column:
    return _has(text, AFFIRMATION)


def correction_score(text: Column, read_as: Callable[[str], str] = _u) -> Column:
    """Sum of the weights of the cues, 1 at most; 0 for praise whose strongest cue weighs under 0.5, and for no text.

    read_as: what the patterns mean, Python's (the default) or, with sql_pattern, SQL's, which differ next to letters and spaces beyond ASCII.
    """
    has = lambda p: F.coalesce(text.rlike(read_as(p)), F.lit(False))
    weights = [F.when(has(p), F.lit(w)).otherwise(F.lit(0.0)) for p, w in CORRECTION_CUES]
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    blank = text.isNull() | ~_has(text, r"\S")
    return F.when(blank | (has(AFFIRMATION) & (F.greatest(*weights) < 0.5)), F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _u(r"\A\s+|\s+\z"), "")


def compact_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, _u(r"\s+"), " "))


def claim_key(text: Column, limit: int = 160) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), 1, limit)


def title_of(text: Column, fallback: Column) -> Column:
    """The first line that is not blank, without heading marks, 160 characters at most."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"), strip), lambda s: s != "")
    first = F.try_element_at(lines, F.lit(1))
    bare = F.when(first.startswith("#"), strip(F.regexp_replace(first, "^#+", ""))).otherwise(first)
    return F.when(F.coalesce(bare, F.lit("")) != "", F.substring(bare, 1, 160)).otherwise(F.when(first.isNull(), F.substring(fallback, 1, 160)).otherwise(fallback))


def summary_of(text: Column, limit: int = 600) -> Column:
    return F.substring(compact_space(text), 1, limit)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_u(r"([\w-]{2,})")), 1)


def meaningful_terms(text: Column) -> Column:
    return F.array_except(F.array_distinct(terms(text)), F.array(*map(F.lit, dict.fromkeys(STOP_TERMS + NEGATIONS))))


def has_negation(text: Column) -> Column:
    return F.arrays_overlap(terms(text), F.array(*map(F.lit, NEGATIONS)))


def fts_terms(query: Column, most: int = 24) -> Column:
    return F.slice(F.array_except(F.array_distinct(terms(query)), F.array(*map(F.lit, FTS_STOPWORDS))), 1, most)


def legacy_fts_terms(query: Column, most: int = 8) -> Column:
    return F.slice(terms(query), 1, most)


def dedupe_text(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_u(r"([\w-]+)")), 1), " ")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.length(text) / 4), F.lit(1)).cast("long")


def is_catalog_stub(text: Column) -> Column:
    """A body that is a path with a file suffix and little else."""
    flat = compact_space(text)
    short = (F.length(flat) <= 320) & (F.size(F.split(flat, " ")) <= 18)
    path = _has(flat, r"(?i)^(?:[^.!?\n]{0,120}\s+)?(?:/Users/|/private/|~/|[A-Za-z]:\\)\S+$")
    return short & path & _has(flat, r"\.[A-Za-z0-9]{1,8}(?:\s|$)")


def sanitize(text: Column) -> Column:
    """Training text without transport residue, secrets, e-mail addresses, phone numbers and private ids; idempotent."""
    return _once(_both(F.coalesce(text, F.lit(""))), lambda x: _sanitized(x["raw"], x["low"]))


def _sanitized(raw: Column, low: Column) -> Column:
    text = _replaced(raw, raw.contains("[["), REPLY_PREFIX, "")
    text = _redacted(_replaced(text, _may(low, UNTRUSTED_BLOCK), UNTRUSTED_BLOCK, ""), raw, low)
    text = _replaced(text, _may(low, EMAIL), EMAIL, "[REDACTED_EMAIL]")
    text = _replaced(text, raw.rlike(_u(PHONE_PART)), PHONE, "[REDACTED_PHONE]")
    text = _replaced(text, _may(low, LABELLED_ID), LABELLED_ID, "$1$2[REDACTED_ID]")
    return _stripped(_replaced(text, _may(low, ACCOUNT_VALUE), ACCOUNT_VALUE, "$1$2[REDACTED_ID]"))


def _stripped(text: Column) -> Column:
    """strip(), which looks at the whole text only where an end is white."""
    return _once(text, lambda t: F.when(F.concat(F.substring(t, 1, 1), F.right(t, F.lit(1))).rlike(_u(r"\s")), strip(t)).otherwise(t))


def is_process_chatter(text: Column) -> Column:
    """Acknowledgements, heartbeats and narration of next steps, unless a verified result with a judgement stands beside them."""
    return _once(_both(sanitize(text)), lambda x: _chatter(x["raw"], x["low"]))


def _chatter(target: Column, low: Column) -> Column:
    verified = _has(target, VERIFIED) & _has(target, CONCRETE)
    judged = _has(target, JUDGMENT)
    n_intents = F.when(_may(low, INTENT) | (low.contains("let") & low.rlike(_u(LET_ME))), F.regexp_count(target, F.lit(_u(INTENT)))).otherwise(F.lit(0))
    first_at = F.regexp_instr(target, F.lit(_u(INTENT)))

    def of_intents(n: Column) -> Column:
        # what stands after the last intent, without closing marks; another sentence in it makes the turn substantive
        tail = F.regexp_replace(F.element_at(F.split(target, _u(INTENT)), -1), r"[ \t\r\n.!?;:]+\z", "")
        hollow = (n >= 2) | ~_has(tail, r"[.!?]\s+(?=\S)")
        return F.when(n == 0, F.lit(False)).when((verified & judged) | (_has(target, CHANGED) & (first_at > 1)), F.lit(False)).otherwise(hollow)

    return (
        F.when((target == "") | (_may(low, BLOCKED) & _has(target, BLOCKED)), F.lit(False))
        .when(_may(low, HEARTBEAT) & _has(target, HEARTBEAT), F.lit(True))
        .when(_has(target, ACKNOWLEDGED) & ~(verified | judged), F.lit(True))
        .otherwise(_once(n_intents, of_intents))
    )


def scrub_reasons(target: Column, example: Column, dataset: Column) -> Column:
    """Slugs of the exclusion rules that fire, in a fixed order; near duplicates are found elsewhere."""
    target, example = F.coalesce(target, F.lit("")), F.coalesce(example, F.lit(""))
    held = F.struct(_both(target).alias("t"), _both(example).alias("e"), dataset.alias("dataset"))
    return _once(held, lambda x: _reasons(x["t"]["raw"], x["t"]["low"], x["e"]["raw"], x["e"]["low"], x["dataset"]))


def _reasons(target: Column, low: Column, example: Column, low_example: Column, dataset: Column) -> Column:
    bare = _stripped(target)
    rules = (
        ("secret_residue", F.size(_named(target, low, LEAKS)) > 0),
        ("entropy_blob", F.size(entropy_spans(target)) > 0),
        ("length", (F.length(example) > MAX_EXAMPLE) | (F.length(bare) < MIN_TARGET)),
        ("refusal_only", _once(bare, lambda b: (F.length(b) < 240) & _has(b, REFUSAL))),
        ("error_dump", target.contains("Traceback (most recent call last)") | (target.contains('File "') & (F.regexp_count(target, F.lit(STACK_LINE)) >= 2))),
        ("managed_block_leak", _may(low, MANAGED_BLOCK) & _has(target, MANAGED_BLOCK)),
        ("envelope_residue", (_may(low, ENVELOPE) & _has(target, ENVELOPE)) | (_may(low_example, ENVELOPE) & _has(example, ENVELOPE))),
        ("transport_residue", _may(low_example, TRANSPORT) & _has(example, TRANSPORT)),
        ("injection_flagged", F.size(_named(target, low, INJECTIONS)) > 0),
        ("process_chatter", (dataset == "sft") & _once(_both(_sanitized(target, low)), lambda x: _chatter(x["raw"], x["low"]))),
    )
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def is_style_admissible(text: Column) -> Column:
    """Prose, not a command, a bare link or path, a code block or mostly signs."""
    bare = strip(F.coalesce(text, F.lit("")))
    letters = F.length(F.regexp_replace(bare, r"[^\p{L}\s]", "")) / F.greatest(F.length(bare), F.lit(1))
    odd = _has(bare, r"^\s*/[a-zA-Z]") | _has(bare, r"^\s*https?://\S+\s*$") | _has(bare, r"^\s*```")
    path = _has(bare, r"^\s*(?:/|~/|\./)?[\w./-]+\.\w{1,5}\s*$") & ~bare.contains(" ")
    return (bare != "") & ~odd & ~path & (letters >= 0.5)


def source_kind(uri: Column) -> Column:
    return F.when(uri.isNull() | (uri == ""), "inline").when(uri.rlike("^https?://"), "web").otherwise("local")


def is_tool_error(text: Column) -> Column:
    return _has(text, TOOL_ERROR)


#: Scanners that SQL can call by name, once register() has run.
SQL_FUNCTIONS = {
    "eg_redact": "redact_secrets", "eg_claim_key": "claim_key", "eg_sanitize": "sanitize", "eg_correction_score": "correction_score",
    "eg_leaks": "secret_leaks", "eg_injections": "injections", "eg_summary": "summary_of", "eg_dedupe_text": "dedupe_text",
}

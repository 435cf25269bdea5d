"""Rules that sort captured prompts: structural rejects, signal score, injected prompts, noise reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that classify prompts (Java regular expressions; (?i) ignores ASCII case, (?m) takes lines).
STANDING_DIRECTIVE = r"(?i)\b(always|never|by default|from now on|going forward|in general|whenever|every time|as a rule|prefer .{0,40} over)\b"
RATIONALE = (
    r"(?im)\b(because|since|so that|to avoid|otherwise|too specific|we might (extend|need)|reads better)\b|\bas .{0,30}(more|better|efficiently)\b|\bshould(n'?t| not)? (be|not|fix|own|live|stay|go)\b"
    r"|\bmust(n'?t| not)? \w|\bneeds? to be\b|\bdoesn'?t need to\b|\bdon'?t (want|need)\b|\bi (don'?t )?(like|prefer|want)\b|\bwhy we (need|use|chose|keep)\b|\bmeaning that\b"
    r"|^\s*(diagnosis|root cause|conclusion)\s*:|^\s*[\w'-]+(\s[\w'-]+){0,3}\s*=\s+\S|\bi own\b|\bwe don'?t \w+, we\b|\b(not a good idea|doesn'?t make sense|doesn'?t fit)\b"
    r"|\bis an? [\w-]+ (workflow|pattern|system|approach|product|convention)\b|\b(philosophy|principle|north star|vision)\b|\bi'?m more with\b|^\s*if i (remember|recall)\b|\bthe only way\b"
)
CORRECTION_SHAPE = r"(?i)^\s*(no,?\s|stop\b|don'?t\b|actually\b|instead\b|wait[,\s])"
CORRECTION = r"(?i)^\s*(no|stop|don't|dont|wait|actually|instead|but)\b"
#: The same as JavaScript and as RE2 read it, in Java's terms: to both a letter outside ASCII ends a word, to Java it goes on with it.
#: JavaScript's white space is Unicode's; RE2's has no vertical tab, and its (?i) takes the long s for an s.
SPACES = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_CORRECTION = rf"(?i)^[{SPACES}]*(no|stop|don't|dont|wait|actually|instead|but)(?![0-9A-Za-z_])"
_CORRECTION_RE2 = r"(?i)^[\t\n\f\r ]*(no|[sſ]top|don't|dont|wait|actually|in[sſ]tead|but)(?![0-9A-Za-z_])"
INJECTED_PREFIXES = ("Base directory for this skill:", "<command-name>", "<command-message>", "<command-args>", "<local-command-", "<system-reminder>", "<bash-input>", "<bash-stdout>", "<bash-stderr>", "The user just ran /")
SKILL_HEADING = r"^#[ \t]+[A-Z][\w-]+(?:[ \t]+[\w-]+)*[ \t]+Skill[ \t]*$"
NOISE_REASONS = ("^one-off", "no[- ]durable", "^specific-bug-report", "session[- ]chatter", "^transient", r"^noise\b", "^bulk-triage", "^aging: low-signal", "^intake: zero-signal")
INTERRUPT = r"^\s*\[Request interrupted by user( for tool use)?\]"
ROLEPLAY_MARK = r"(?i)\[ai-whisper duo\]"
ROLEPLAY_VERB = r"(?i)\b(you (are|play)|you'?re playing|act(ing)? as|play(ing)?)\b"
ROLEPLAY_NOUN = r"(?i)\b(character|persona|duo|roleplay|in character)\b"
RESUME = r"(?i)^\s*(continue from where|let'?s? resume|resume (with|from) (the )?(current|previous|last)|recap me|the workflow halted)"
SCREENSHOT = r"\S*[/\\][Ss]creenshot[^\n]*?\.(?:png|jpe?g)\b"
STRUCTURED_LINE = r"""^\s*"?[\w.@/-]+"?\s*[:=]\s*\S|^\s*\d{4}-\d{2}-\d{2}[T ]|\b(INFO|WARN|ERROR|DEBUG)\b"""
PASTED = r"^\s*(#|<INSTRUCTIONS>|🧠)"
PASTED_AGENTS = r"(?i)^\s*#?\s*AGENTS\.md\b"
PSEUDO = r"(?i)This session is being continued from a previous conversation|<task-notification>|<tool-use-id>|<image name="
IMAGE = r"\[Image #\d+\]"
HANDOFF = r"(?i)\bThis is an autonomous workflow\b|\bno human will respond\b"
FINDINGS = r"(?im)^\s*(?:[-*]\s*)?(\d+\.\s*)?(High|Medium|Critical|Major|Low|P[12]):"
FINDINGS_ASK = r"(?i)\b(check|more|some|one (more|last))\b.{0,20}\b(findings|finding|pass)\b"
ERROR_LOG = r"(?i)Uncaught [\s\S]{0,200}?(Error|Exception)|TypeError|ENOENT|EISDIR|exited with code|npm error|API Error:\s*\d|-32601|UserWarning|build failed"
ERROR_START = r"(?i)^\s*(got (some )?error|still the same|saw this error|got this running|how about this error)"
UI_TWEAK = r"(?i)\b(too dimmed|smaller|bigger|too big|lighter|bolder|gradient|\d+px|margin|flex column|align|highligh|looks (bad|ugly)|broken layout|titlebar|fps|unreadable|line break|capitalized)\b"
ACKNOWLEDGED = ("ok", "okay", "good", "alright", "yes", "no", "fine", "b", "a")
CONTROL = r"(?i)\blet'?s? (write|brainstorm)\b|\bwrite plan\b|\bpush to master\b|\bjust merge\b|\bcontinue with the rest\b|\bgo ahead with phase\b|\bsync plan\b|\bwrite this down\b|\bkill your shell\b|\bmonitor and fix\b|\bsmoke test\b"


def at_words(pattern: str) -> str:
    """The same pattern (flags, branches), with branches that begin at a word's edge under one \\b: they are tried at edges, not at every character."""
    flags, body = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    branches, depth, i = [""], 0, 0
    while i < len(body):
        c = body[i : i + 2] if body[i] == "\\" else body[i : body.index("]", i) + 1] if body[i] == "[" else body[i]
        depth += (c == "(") - (c == ")")
        branches = [*branches, ""] if c == "|" and not depth else [*branches[:-1], branches[-1] + c]
        i += len(c)
    words, rest = [b[2:] for b in branches if b.startswith(r"\b")], [b for b in branches if not b.startswith(r"\b")]
    return flags + "|".join(([r"\b(?:" + "|".join(words) + ")"] if words else []) + rest)


_RATIONALE, _CONTROL = at_words(RATIONALE), at_words(CONTROL)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(body: Column | str) -> Column:
    """A prompt without white space around it."""
    return F.trim(F.regexp_replace(_c(body), r"^\s+|\s+$", ""))


def structural_reject(body: Column | str, trimmed: Column | str | None = None) -> Column:
    """Name of the first rule that calls a prompt structural noise, else null. One CASE chain: later rules run only where earlier ones don't hit.
    trimmed: the body `stripped`, where it is at hand."""
    b = _c(body)
    t = stripped(b) if trimmed is None else _c(trimmed)
    standing = b.rlike(STANDING_DIRECTIVE)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"\S"))
    structured = F.size(F.filter(lines, lambda x: x.rlike(STRUCTURED_LINE))) / F.size(lines)
    first = F.regexp_replace(F.lower(F.element_at(F.split(t, r"\s+"), 1)), "[.,]$", "")
    return (
        F.when(b.rlike(INTERRUPT), "interrupt-marker")
        .when(b.rlike(ROLEPLAY_MARK) | (b.rlike(ROLEPLAY_VERB) & b.rlike(ROLEPLAY_NOUN)), "duo-roleplay")
        .when((F.length(t) < 200) & b.rlike(RESUME) & ~standing, "resume-kickoff")
        .when(b.contains("creenshot") & (F.length(F.regexp_extract(b, SCREENSHOT, 0)) > F.length(t) * 0.5), "screenshot-path")
        .when(t.rlike(r"^[{\[]") & F.try_parse_json(t).isNotNull() | (F.size(lines) >= 3) & (structured > 0.6), "structured-blob")
        .when(b.rlike(PASTED) | b.rlike(PASTED_AGENTS), "pasted-doc")
        .when(b.rlike(PSEUDO) | b.rlike(IMAGE) & (F.length(F.trim(F.regexp_replace(b, IMAGE, ""))) < F.length(b) * 0.5), "harness-pseudo-prompt")
        .when(b.rlike(HANDOFF), "workflow-handoff")
        .when(b.rlike(FINDINGS) | b.rlike(FINDINGS_ASK), "findings-dump")
        .when(b.rlike(ERROR_LOG) | b.rlike(ERROR_START), "error-log")
        .when(b.rlike(UI_TWEAK) & ~standing, "ui-micro-tweak")
        .when(first.isin(*ACKNOWLEDGED) | first.rlike(r"^\d+$") | b.rlike(_CONTROL), "process-control-or-vague-ack")
        .when(F.substring(b, 1, 200).contains("?") & ~standing, "question")
        .when(F.length(t) < 25, "filler")
    )


def signal_score(body: Column | str) -> Column:
    """0 to 3: a standing directive, a rationale, a correction."""
    b = _c(body)
    return sum((b.rlike(p).cast("int") for p in (STANDING_DIRECTIVE, _RATIONALE, CORRECTION_SHAPE)), F.lit(0))


def capture_tier(body: Column | str) -> Column:
    """high for any signal, else low."""
    b = _c(body)
    return F.when(b.rlike(STANDING_DIRECTIVE) | b.rlike(_RATIONALE) | b.rlike(CORRECTION_SHAPE), "high").otherwise("low")


def is_injected(text: Column | str) -> Column:
    """Whether a harness wrote the prompt, not a user."""
    t = F.regexp_replace(_c(text), r"^\s+", "")
    hit = t.startswith(INJECTED_PREFIXES[0])
    for p in INJECTED_PREFIXES[1:]:
        hit = hit | t.startswith(p)
    return hit | F.element_at(F.split(t, "\n", 2), 1).rlike(SKILL_HEADING)


def is_correction(text: Column | str) -> Column:
    """Whether a prompt corrects what came before."""
    return _c(text).rlike(_CORRECTION)


def is_correction_re2(text: Column | str) -> Column:
    """The same as SQL twins judge it."""
    return _c(text).rlike(_CORRECTION_RE2)


def is_noise_reason(reason: Column | str) -> Column:
    """Whether a deprecation reason calls the capture noise; null is no reason."""
    r = F.trim(_c(reason))
    return F.coalesce(r.rlike("(?i)" + "|".join(f"(?:{p})" for p in NOISE_REASONS)), F.lit(False))


#: Lines that older agents put at the end of a record's body in place of scope fields.
_TRAILER_TAGS = "scopeFiles scopeTags source confidence globalScope".split()
TRAILER_LINE = r"[^\S\n]*(?:" + "|".join(f"<{x}>[^\\n]*?</{x}>" for x in _TRAILER_TAGS) + r"|</invoke>)[^\S\n]*"
#: The longest end of a body of which every line is such a line or blank; what stands before it, and it.
TRAILER = rf"(?s)^(|.*?\n)({TRAILER_LINE}(?:\n(?:{TRAILER_LINE}|[^\S\n]*))*)$"


def _listed(payload: Column) -> Column:
    """Values of a scope line: a JSON list of strings alone, or else words between commas; trimmed, each once, blanks left out."""
    raw = F.trim(payload)
    is_json = raw.startswith("[") | raw.startswith("{")
    parsed = F.try_parse_json(raw)
    strings = F.when(F.schema_of_variant(parsed) == "ARRAY<STRING>", F.from_json(raw, "array<string>"))
    values = F.when(is_json, F.coalesce(strings, F.array().cast("array<string>"))).otherwise(F.split(raw, ","))
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""))


def legacy_scope(body: Column | str) -> Column:
    """(matched, files, tags, body): scope lines at the very end of a body read and cut off; such lines anywhere else stay. Without a
    trailer the body is as it was, with one it ends in one line feed or is empty."""
    b = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    trailer = F.regexp_extract(b, TRAILER, 2)
    matched = trailer != ""
    of = lambda tag: _listed(F.regexp_extract(trailer, f"(?s)<{tag}>(.*?)</{tag}>", 1))
    left = F.regexp_replace(F.regexp_extract(b, TRAILER, 1), r"\s+$", "")
    left = F.when(left == "", "").otherwise(F.concat(left, F.lit("\n")))
    return F.struct(matched.alias("matched"), of("scopeFiles").alias("files"), of("scopeTags").alias("tags"), F.when(matched, left).otherwise(b).alias("body"))

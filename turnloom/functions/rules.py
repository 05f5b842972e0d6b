"""Statement rules and structure patterns: fixed values of the extraction rules.

Written once with ``\\<`` and ``\\>`` for word boundaries; `text.ascii_words`
and `text.re2_words` give the Java and RE2 spellings.
"""

from __future__ import annotations

from turnloom.functions.text import WS, WS_CHARS

_Q = "['’]"

NEGATED_COGNITION = (
    rf"\<(?:don{_Q}t|do not|doesn{_Q}t|does not){WS}+(?:know|think|understand|see|remember|care|mind|believe)\>"
)
SHOULD_NOT = rf"\<should(?:{WS}+not|n{_Q}t)\>"
MUST_NOT = (
    rf"\<(?:do not|don{_Q}t|dont|must not|mustn{_Q}t|never|avoid|cannot use|can{_Q}t use|no longer use|without using)\>"
)
MUST = r"\<(?:must|have to|has to|required to|is required|are required|needs? to be|only use)\>"
SHOULD = r"\<should\>"
PREFERENCE = (
    rf"\<(?:I|we){WS}+(?:really{WS}+)?(?:prefer|like to use|love using)\>"
    rf"|\<(?:I|we)(?:{_Q}d|{WS}+would){WS}+rather\>"
    r"|\<my preference\>"
)
DECISION = (
    rf"\<(?:I|we)(?:{_Q}ve|{WS}+have)?{WS}+decided\>"
    r"|\<decided to\>"
    rf"|\<(?:I|we)(?:{_Q}ll|{WS}+will){WS}+(?:use|go with|stick with|adopt)\>"
    r"|\<going with\>"
    rf"|\<let{_Q}?s{WS}+(?:use|go with|stick with|adopt)\>"
    r"|\<settled on\>"
    rf"|\<(?:I|we){WS}+(?:chose|picked|selected)\>"
    rf"|\<we(?:{_Q}re|{WS}+are){WS}+using\>"
)
TASK = (
    rf"^(?:please{WS}+)?(?:implement|build|add|create|fix|write|refactor|set up|make|update|migrate|remove"
    r"|design|deploy|test)\>"
    r"|\<(?:need|needs|want|wants|trying|plan|plans) to\>"
    r"|\<next step\>"
    r"|\<to-?do\>"
)
FACT = (
    rf"\<(?:I{_Q}m|I am|we{_Q}re|we are){WS}+"
    r"(?:building|developing|working on|creating|making|planning|writing|designing)\>"
    rf"|\<(?:the|our|my|this){WS}+(?:project|app|application|stack|backend|frontend|database|api|service|codebase"
    rf"|repo|repository|website|site|team){WS}+(?:is|uses|runs|has|will|was|needs)\>"
    rf"|\<(?:is|are){WS}+(?:written|built|implemented){WS}+(?:in|with|on)\>"
)
CONFIDENCE = {
    "question": 0.8,
    "constraint_strong": 0.7,
    "constraint_soft": 0.55,
    "preference": 0.6,
    "decision": 0.65,
    "decision_proposed": 0.5,
    "task": 0.5,
    "fact": 0.5,
}
MIN_SEGMENT = 6
MAX_SEGMENT = 500

FENCE = r"(?s)```([^\n`]*)\n(.*?)```"
LINK = rf"(!?)\[([^\]\n]{{1,200}})\]\((https?://[^{WS_CHARS})]+)\)"
BARE_URL = rf"https?://[^{WS_CHARS}<>()\[\]\"'`]+"
LIST_MARKER = rf"^(?:[-*•]|\d{{1,3}}[.)]){WS}+"
LETTERS = r"[A-Za-z\x{00C0}-\x{FFFF}]{2}|[\x{10000}-\x{10FFFF}]"
# What ends a piece: white space after a sentence mark, or a line end.
CUT = r"([.!?][" + WS_CHARS.replace(r"\n", "") + r"]+|\n)"

# Hint sets of the rule summary: a sentence scores one point per pattern hit.
DECISION_HINTS = (
    r"\<decided?\>",
    r"\<chose\>|\<chosen\>",
    r"\<will use\>|\<going with\>|\<go with\>",
    r"\<selected?\>",
    r"\<we(?:'re| are) using\>",
)
TASK_HINTS = (
    r"\<(?:need|want|trying) to\>",
    r"\<how (?:do|can|should) i\>",
    r"\<next step\>",
    r"\<current(?:ly)? working on\>",
    r"\<todo\>",
)
CONTEXT_HINTS = (r"\<project\>", r"\<backend\>|\<frontend\>|\<database\>", r"\<stack\>", r"\<using\>")

# One word or phrase that every rule needs: a cheap test before the rule chain.
NEEDED = (
    "should", "do not", "don't", "don’t", "dont", "must", "never", "avoid", "cannot use", "can't use", "can’t use",
    "no longer use", "without using", "have to", "has to", "required", "need", "only use", "prefer", "like to use",
    "love using", "rather", "decided", "use", "go with", "stick with", "adopt", "going with", "settled on", "chose",
    "picked", "selected", "using", "implement", "build", "add", "create", "fix", "write", "refactor", "set up", "make",
    "update", "migrate", "remove", "design", "deploy", "test", "want", "trying", "plan", "next step", "todo", "to-do",
    "developing", "working on", "creating", "making", "writing", "project", "app", "stack", "backend", "frontend",
    "database", "api", "service", "codebase", "repo", "website", "site", "team", "written", "built",
)


def word_tree(words) -> str:
    """One pattern for many words, branching letter by letter instead of word by word."""
    heads: dict[str, list[str]] = {}
    ends = False
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
        else:
            ends = True
    if ends:
        return ""  # a shorter word already decides; what follows does not matter
    branches = [("\\" + h if h in "-.?" else h) + word_tree(rest) for h, rest in heads.items()]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


QUICK = r"\?|\<" + word_tree(NEEDED)

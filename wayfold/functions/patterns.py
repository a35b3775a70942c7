"""Patterns, word lists and thresholds that decide what a row is called.

Fixed values: results depend on them. They are written for java.util.regex: `\\z` for the end of the text,
(?d) so that only a newline ends a line."""

CACHE_PATH = r"/__pycache__/|\.pyc\z|/\.pytest_cache/"
SCRIPT_PATH = r"\.(?:py|sh|bash|js|mjs|ts|rb|pl|r|jl)\z"
PROMPT_PATH = r"/[A-Za-z0-9_./-]*[A-Za-z0-9_/-]"
ERROR_MARKER = (
    r"(?dm)^Exit code -?[1-9][0-9]*|^\[exit_code\] -?[1-9][0-9]*|Traceback \(most recent call last\)"
    r"|^FAILED\b|^FAIL:|\b[1-9][0-9]* failed\b|test result: FAILED|^[A-Za-z]*Error:"
)
TEST_COMMAND = (
    r"(?:^|[;&|(\n]|\bthen\b|\bdo\b)\s*(?:[A-Za-z_][A-Za-z0-9_]*=\S*\s+)*(?:(?:timeout\s+\S+|time|env|sudo)\s+)*"
    r"(?:(?:python3?|uv\s+run|poetry\s+run|pipenv\s+run|npx|bunx)\s+(?:-m\s+)?)?"
    r"(?:pytest|py\.test|unittest|tox|nox|ctest|jest|vitest|mocha|(?:npm|yarn|pnpm|bun)(?:\s+run)?\s+test|(?:cargo|go)\s+test"
    r"|make(?:\s+-C\s+\S+)?\s+(?:test|check)|(?:(?:ba)?sh\s+)?\S*(?:test\.sh|run_tests))\b"
)
SUCCESS_CLAIM = (
    r"(?i)\b(?:all (?:\d+ )?tests?|tests? (?:now )?(?:pass|passes|passed|passing)|verified"
    r"|works?|working|succeeded|successfully|fixed|done|complete[ds]?)\b"
)
NOT_DONE = (
    r"(?i)\b(?:not|cannot|could ?n.t|could not|did ?n.t|was ?n.t|is ?n.t|unable"
    r"|fail(?:ed|s|ing|ure)?|incomplete|unfinished|unresolved|unfortunately)\b"
)
BACKGROUNDED = r"(?:moved to the background \(ID: |running in background with ID: )([a-z0-9]+)"
JOB_LAUNCH = r"(^|[^&>|\\])&([^&>]|\z)|\bnohup\b|\bsetsid\b|\bdisown\b"
REDIRECT_TARGET = r">>?\s*([^\s;&|)]+)"
SHELL_VARIABLE = r"\$\w+|\$\{[^}]*\}"
NAME_BEFORE, NAME_AFTER = r"(^|[\s\"'/=])", r"(\z|[\s\"';)|])"
DIR_BEFORE, DIR_AFTER = r"(^|[\s\"'=])", r"(\z|[\s\"';)|/])"
STOP_TOOLS = ("Stop", "StopFailure")
WRITE_TOOLS = ("Write", "Edit", "MultiEdit", "NotebookEdit")
IDLE_SECONDS = 120
VARIANT_OVERLAP = 0.5
VARIANT_MIN_LINES = 5

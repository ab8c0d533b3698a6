"""Texts of diagnostics: what a parser found, in words that name the agent and the place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The text for a finding by agent, the place at {}; "*" is any agent, {a} its id
LINE = {"*": "skipping malformed line {}"}
RECORD = {
    "claude": "skipping malformed assistant record {}", "codebuddy": "skipping malformed assistant record {}", "amp": "skipping malformed amp message {}", "commandcode": "skipping malformed usage at {}",
    "copilot": "skipping malformed copilot usage record {}", "pi": "skipping malformed pi usage {}", "omp": "skipping malformed omp usage {}", "prime": "skipping malformed prime usage {}",
    "gajae": "skipping malformed gajae usage {}", "kimchi": "skipping malformed kimchi usage {}", "opencode": "skipping malformed opencode message {}", "mimocode": "skipping malformed mimocode message {}",
    "kilo": "skipping malformed kilo {}", "goose": "skipping malformed goose session {}", "hermes": "skipping malformed hermes session {}", "zed": "skipping malformed zed thread {}", "zcode": "skipping malformed zcode usage {}",
    "devin": "skipping malformed devin message {}", "trae": "skipping malformed trae interaction {}", "droid": "skipping malformed droid session {}", "*": "skipping malformed {a} record {}",
}
WHOLE = {
    "amp": "skipping malformed amp thread {}", "droid": "skipping malformed droid session {}", "gemini": "skipping unreadable gemini chat {}", "trae": "skipping malformed trae trajectory {}", "cline": "skipping unreadable cline session {}",
    "roo": "skipping unreadable roo task {}", "kilocode": "skipping unreadable kilocode task {}", "reasonix": "skipping malformed reasonix file {}", "deepseek": "skipping malformed deepseek file {}", "*": "skipping unreadable file {}",
}
OTHER = {
    "malformed session": {"*": "skipping malformed {a} session metadata {}"},
    "no model context": {"*": "{a} session without turn_context model: {}"},
    "unreadable zstd stream": {"*": "skipping malformed {a} file {}"},
    "truncated zstd stream": {"*": "skipping undecodable tail of {a} file {}"},
    "time zone not found": {"*": "naive timestamps, no usable anchor in {}"},
    "missing timestamp": {"commandcode": "skipping message without a timestamp at {}", "*": "skipping malformed {a} record {}"},
}
#: What parsers say, and the texts for it
FOUND = {
    "malformed JSON line": LINE, "malformed usage record": RECORD, "malformed record": RECORD, "malformed message": RECORD, "malformed conversation": RECORD, "malformed thread": RECORD, "usage without a model": RECORD, "session without usage": RECORD,
    "malformed JSON": WHOLE, "malformed file": WHOLE, **OTHER,
}


def worded(agent: str) -> Column:
    """The text of a diagnostic row (message, location)."""
    out, message = F.col("message"), F.col("message")
    for found, texts in FOUND.items():
        before, after = texts.get(agent, texts["*"]).replace("{a}", agent).split("{}")
        out = F.when(message == found, F.concat(F.lit(before), F.col("location"), F.lit(after))).otherwise(out)
    unreadable = F.concat(F.lit(f"unable to read {agent} database "), F.col("location"), F.regexp_extract("message", "^unreadable database(.*)$", 1))
    return F.when(message.startswith("unreadable database"), unreadable).otherwise(out)

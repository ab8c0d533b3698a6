"""Readers by agent, in the registry's fixed order."""

from . import databases, documents, logs, mixed

_ALL = {r.id: r for r in (*logs.READERS, *documents.READERS, *databases.READERS, *mixed.READERS)}

#: Agent ids in registry order
IDS = (
    "claude codex gemini opencode mimocode commandcode copilot amp droid qwen pi omp prime gajae kimchi grok augment codebuff codebuddy jcode mux zcode roo cline kilo kilocode openclaw kimi junie devin hermes goose zed cherrystudio opencodereview trae deepseek reasonix kiro fx"
).split()

REGISTRY = {name: _ALL[name] for name in IDS if name in _ALL}

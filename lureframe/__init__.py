"""lureframe: message-risk triage as DataFrame operators."""
from .lexicon import DEFAULT, Lexicon, Rule

__all__ = ["DEFAULT", "Lexicon", "Rule"]

"""All queries of the subpackage; importing the modules registers them."""

from sitepanel.llm import bpe, collocations, contextmix, langid, lengths, lexical, licenses, mixing, neardup, secrets, simhash, toxicity, vafile  # noqa: F401
from sitepanel.llm.registry import ORACLES, QUERIES  # noqa: F401

"""Importing this module registers every query of the subpackage."""

import corpus_pipeline
from plumbline.llm import base, conversation_trie, filter_audit, html_text, langid, ngram_lm, suffix_dedup, toxicity, url_filter  # noqa: F401
from plumbline.llm.base import QUERIES, SQL  # noqa: F401

base.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

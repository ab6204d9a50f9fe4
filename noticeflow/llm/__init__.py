"""Operators for preparing large training corpora.

Nothing outside this subpackage imports it.  ``noticeflow.llm.queries`` lists
the registered queries; ``corpus_pipeline.py`` chains five of the operators.
"""

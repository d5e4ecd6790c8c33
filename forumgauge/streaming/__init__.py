"""There are no streaming operators: every analysis here is a batch report.

The row-wise operators (cleaning, portioning, tokenising, lexicon scoring) are plain
column expressions, so ``df.transform`` applies them to a streaming DataFrame as well;
``tests/test_streaming.py`` holds that property.
"""

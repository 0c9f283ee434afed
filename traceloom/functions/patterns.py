"""Patterns and words that existing texts and reports are written in."""

RESULT_BLOCK = r"(?s)<result>(.*?)</result>"
APPENDS_TO_RESULT = r"\bresult\s*\.?\s*append\b"
WRITES_RESULT = r"f\.write\(str\(result\)\)"
RETURNED_NAME = r"\breturn\s+(\w+)"
INPUTS_BEFORE_RESULTS = r"(?s)inputs\s*=\s*(\[.*?\])\s*\nresults"
INPUTS_ASSIGNMENT = r"\binputs\s*="
ASSERTED_FUNCTION = r"\bassertion\(\s*([A-Za-z_]\w*)\s*\("
CALLED_NAME = r"\b([A-Za-z_]\w*)\s*\("
TRACE_ITEM_GAP = r"\s+(?='[^']+':)"
ROUTED_WORDS = ("results", "for", "assertion")
ROUTED_OFFSETS = {"results": 10, "assertion": 14}
LOOP_HEAD = "result = []\nfor inp in inputs:"
APPENDED = ("    result.append(", ")")
UNTRACED_NAMES = ("inputs", "inp")
BLOCK_RANKS = {"entry": 0, "normal": 1, "loop_head": 2, "loop_body": 3, "try": 3, "then": 4, "else": 4, "condition": 5, "return": 6}
TRUNCATED = "TRUNCATED"
MOST_BLOCKS = 500
MOST_LINE_EVENTS = 5000

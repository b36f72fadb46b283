"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexiloom.llm.ann import op1_ann
from lexiloom.llm.decontaminate import op9_decontaminate
from lexiloom.llm.langid import op2_langid
from lexiloom.llm.lines import OP7_SQL, op7_lines
from lexiloom.llm.mixing import OP5_SQL, op5_mix
from lexiloom.llm.quality import op8_quality
from lexiloom.llm.simhash import op10_simhash
from lexiloom.llm.substring import op4_substring
from lexiloom.llm.tokens import op6_tokens
from lexiloom.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_ann": op1_ann,
    "op2_langid": op2_langid,
    "op3_warc": op3_warc,
    "op4_substring": op4_substring,
    "op5_mix": op5_mix,
    "op6_tokens": op6_tokens,
    "op7_lines": op7_lines,
    "op8_quality": op8_quality,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
}
ORACLE: dict[str, str] = {"op3_warc": OP3_SQL, "op5_mix": OP5_SQL, "op7_lines": OP7_SQL}

"""Forms of mixed secrets that the masking stage finds."""

import pytest
from millrace.llm.secrets import MASK, redact

from .data import documents

TOKEN = "AbC123dEf456GhI789jKl012Mn"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"
KEY = "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY12=="
FORMS = [(f"client={TOKEN} ok", TOKEN), (f"it is {TOKEN}.", TOKEN), (f"http://x.org/a?sig={TOKEN}&b=1", TOKEN), (f"bearer {JWT}, then", JWT), (f"key {KEY} end", KEY), (f"/{TOKEN}/", f"/{TOKEN}/")]


@pytest.fixture(scope="module")
def masked_texts(spark):
    rows = [(i, f"{text} {i}", "en", "s", 0, 1, "h", 2, 0.5, "z") for i, (text, _) in enumerate(FORMS)]
    return {r["doc_id"]: r["text"] for r in redact(documents(spark, rows)).collect()}


@pytest.mark.parametrize("i", range(len(FORMS)))
def test_form_is_masked(masked_texts, i):
    text, secret = FORMS[i]
    assert masked_texts[i] == f"{text} {i}".replace(secret, MASK)

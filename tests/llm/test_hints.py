"""The quick look for personal data lets through whatever the generators match."""

import itertools
import re

from cobasket.llm import pii


def test_hint_accepts_every_spelling_of_an_address():
    for before, opening, closing, after in itertools.product(("", " "), ("", "(", "[", "{"), ("", ")", "]", "}"), ("", " ")):
        text = f"{before}{opening}.{closing}{after}".join(("10", "0", "0", "1"))
        assert re.search(pii.WIDE["ip"], text) and re.search(pii.HINT["ip"], text), text


def test_hint_accepts_rules_and_generators():
    texts = {
        "ip": ["1.2.3.4", "10 [.] 0 [.] 0 [.] 1"], "card": ["4111 1111 1111 1111", "4-1-1-1-1-1-1-1-1-1-1-1", "4111.111.111"],
        "phone": ["+1 (", "+1 2", "(12) 34", "12/345"],
    }
    for kind, found in texts.items():
        for text in found:
            if re.search(pii.BASE[kind], text) or re.search(pii.WIDE[kind], text):
                assert re.search(pii.HINT[kind], text), (kind, text)

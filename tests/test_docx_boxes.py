"""Text boxes of a docx paragraph."""

import re

from tests.test_sources import docx_of, md

MC = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def box(text: str, more: str = "") -> str:
    return f"<w:txbxContent><w:p><w:r><w:t>{text}</w:t>{more}</w:r></w:p></w:txbxContent>"


def test_every_text_box_comes_out_once():
    both = lambda k: f"<mc:AlternateContent {MC}><mc:Choice>{box(f'b{k}')}</mc:Choice><mc:Fallback>{box(f'b{k}')}</mc:Fallback></mc:AlternateContent>"
    text = md("docx", docx_of(f"<w:p><w:r><w:t>start</w:t>{''.join(map(both, range(100)))}{box('outer', box('inner'))}</w:r></w:p>"))
    assert re.findall(r"\b(?:b\d+|outer|inner)\b", text) == [*[f"b{k}" for k in range(100)], "outer", "inner"]

"""Source forms that bind a name to a literal."""

import pytest

from mailveil.llm import secrets

KEY = "q8Zr7Lm2Xw9"


@pytest.mark.parametrize("text", [
    f'client_key: str = "{KEY}"', f"let db_pwd: string = '{KEY}';", f'client_key: Optional[str] = "{KEY}"', f'client_key: str | None = "{KEY}"', f'cfg["client_key"] = "{KEY}"',
    f"os.environ['client_key'] = '{KEY}'", f"<clientKey>{KEY}</clientKey>", f'<client_key id="a"> {KEY} </client_key>', f"<client_key><![CDATA[{KEY}]]></client_key>",
    f'note: client_key = "{KEY}"', f'k: str = "{KEY}"\nclient_key = k', f'cfg["k"] = "{KEY}"\nclient_key: str = k', f'client_key: "{KEY}"'])
def test_form(text):
    assert secrets.spans(text)[1] == [(text.index(KEY), 3, text.index(KEY) + len(KEY))]


@pytest.mark.parametrize("text", [f'name: str = "{KEY}"\npassphrase: str', f'cfg["name"] = "{KEY}"', f"<name>{KEY}</name>", "<client_key>plain words</client_key>"])
def test_no_secret(text):
    assert secrets.spans(text)[1] == []

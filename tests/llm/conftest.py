import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def tokenizer():
    return public_tokenizers.path("byte_bpe_50k.json")

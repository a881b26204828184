"""Vocabulary files of public tokenizers, read on the driver and handed to the tasks."""

from __future__ import annotations

import os


def tokenizer_bytes(name: str, folder: str | None = None) -> bytes:
    """The file's bytes, from ``folder`` or the installed ``public_tokenizers``."""
    if folder is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    else:
        path = os.path.join(folder, name)
    with open(path, "rb") as file:
        return file.read()

"""Where vocabulary files are; operators take the path as a parameter."""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

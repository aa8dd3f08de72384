"""What can go wrong with an image's bytes; kind is the name that error columns carry."""


class CodecError(ValueError):
    kind = "Corrupt"


class Corrupt(CodecError):
    pass


class Unsupported(CodecError):
    kind = "UnsupportedFeature"


class UnknownFormat(CodecError):
    kind = "UnknownFormat"


class UnsupportedFormat(CodecError):
    kind = "UnsupportedFormat"

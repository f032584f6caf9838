"""A tiny ONNX file for tests: flatten, one matrix, softmax; made of bytes, as no library writes one here."""

import numpy as np


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _f(number, value):
    """A field: whole numbers as varints, text and bytes by length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _node(kind, inputs, output, axis=None):
    attribute = b"" if axis is None else _f(5, _f(1, "axis") + _f(3, axis) + _f(20, 2))
    return _f(1, b"".join(_f(1, i) for i in inputs) + _f(2, output) + _f(4, kind) + attribute)


def _value(field, name, sizes):
    shape = b"".join(_f(1, _f(2, s) if isinstance(s, str) else _f(1, s)) for s in sizes)
    return _f(field, _f(1, name) + _f(2, _f(1, _f(1, 1) + _f(2, shape))))


def write_model(path, weights, side):
    """softmax(pixels as one row, times weights) of N x side x side x 3 images."""
    w = np.asarray(weights, np.float32)
    tensor = b"".join(_f(1, n) for n in w.shape) + _f(2, 1) + _f(8, "w") + _f(9, w.tobytes())
    nodes = _node("Flatten", ["x"], "flat", 1) + _node("MatMul", ["flat", "w"], "z") + _node("Softmax", ["z"], "p", 1)
    graph = nodes + _f(2, "g") + _f(5, tensor) + _value(11, "x", ["n", side, side, 3]) + _value(12, "p", ["n", w.shape[1]])
    path.write_bytes(_f(1, 8) + _f(7, graph) + _f(8, _f(1, "") + _f(2, 13)))

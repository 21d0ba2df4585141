"""Image operators: numpy kernels, a batch of equal-sized images at a time, behind Arrow-backed functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship


def frequency(ny: int, nx: int) -> np.ndarray:
    """Radius of each coefficient of a real transform, in cycles per pixel."""
    return np.hypot(np.fft.fftfreq(ny)[:, None], np.fft.rfftfreq(nx)[None])


def edge(r: np.ndarray, cut: float, width: float) -> np.ndarray:
    """1 below cut, 0 beyond cut + width, a raised cosine between."""
    return np.where(r <= cut, 1.0, np.where(r >= cut + width, 0.0, 0.5 + 0.5 * np.cos(np.pi * (r - cut) / max(width, 1e-12))))


def filtered(a: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.fft.irfft2(np.fft.rfft2(a) * weight, a.shape[-2:])


def low_pass(a: np.ndarray, cut: float, width: float = 0.02) -> np.ndarray:
    return filtered(a, edge(frequency(*a.shape[-2:]), cut, width))


def high_pass(a: np.ndarray, cut: float, width: float = 0.02) -> np.ndarray:
    return filtered(a, 1 - edge(frequency(*a.shape[-2:]), cut, width))


def b_factor(a: np.ndarray, b: float, pixel: float = 1.0) -> np.ndarray:
    return filtered(a, np.exp(-b / 4 * (frequency(*a.shape[-2:]) / pixel) ** 2))


def shift(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """Translation by phases; whole shifts move pixels around the edge."""
    ny, nx = a.shape[-2:]
    return filtered(a, np.exp(-2j * np.pi * (np.fft.fftfreq(ny)[:, None] * dy + np.fft.rfftfreq(nx)[None] * dx)))


def soft_mask(ny: int, nx: int, radius: float, width: float) -> np.ndarray:
    y, x = np.arange(ny) - ny // 2, np.arange(nx) - nx // 2
    return edge(np.hypot(y[:, None], x[None]), radius, width)


def normalised(a: np.ndarray, radius: float) -> np.ndarray:
    """Background (beyond radius) of mean 0 and deviation 1."""
    outside = soft_mask(*a.shape[-2:], radius, 0) == 0
    back = a[..., outside]
    sd = back.std(-1)[..., None, None]
    return (a - back.mean(-1)[..., None, None]) / np.where(sd > 0, sd, 1)


def without_ramp(a: np.ndarray, radius: float) -> np.ndarray:
    """The image less the plane fitted to its background."""
    ny, nx = a.shape[-2:]
    y, x = np.mgrid[:ny, :nx]
    outside = soft_mask(ny, nx, radius, 0) == 0
    m = np.column_stack((x[outside], y[outside], np.ones(outside.sum())))
    p = np.linalg.lstsq(m, a[..., outside].T, rcond=None)[0]
    return a - (np.tensordot(p.T, np.stack((x, y, np.ones_like(x))), 1))


def resized(a: np.ndarray, ny: int, nx: int) -> np.ndarray:
    """Fourier cropping or padding to a new size, mean value kept."""
    oy, ox = a.shape[-2:]
    f = np.fft.fftshift(np.fft.rfft2(a), axes=-2)
    out = np.zeros((*a.shape[:-2], ny, nx // 2 + 1), complex)
    h, w = min(oy, ny), min(ox, nx) // 2 + 1
    out[..., ny // 2 - h // 2 : ny // 2 - h // 2 + h, :w] = f[..., oy // 2 - h // 2 : oy // 2 - h // 2 + h, :w]
    return np.fft.irfft2(np.fft.ifftshift(out, axes=-2), (ny, nx)) * (ny * nx / (oy * ox))


def fourier_shells(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of two images or volumes in each shell of rounded radius."""
    fa, fb = np.fft.fftn(a), np.fft.fftn(b)
    r = np.rint(np.sqrt(sum(np.meshgrid(*[(np.fft.fftfreq(n) * n) ** 2 for n in a.shape], indexing="ij")))).astype(int).ravel()
    s = [np.bincount(r, v.ravel()) for v in ((fa * fb.conj()).real, abs(fa) ** 2, abs(fb) ** 2)]
    d = np.sqrt(s[1] * s[2])
    return np.where(d > 0, s[0] / np.where(d > 0, d, 1), 0.0)[: min(a.shape) // 2 + 1]


def corrected_shells(masked: np.ndarray, randomised: np.ndarray, start: int) -> np.ndarray:
    """Correlation freed of what the mask adds, from start + 2 on."""
    out = masked.copy()
    k = np.arange(len(out)) >= start + 2
    out[k] = (masked[k] - randomised[k]) / (1 - randomised[k])
    return out


def project(volume: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Projection of a cube along z after rotation, by the central slice with linear interpolation."""
    n = volume.shape[0]
    f = np.fft.fftshift(np.fft.fftn(np.fft.ifftshift(volume)))
    k = np.arange(n) - n // 2
    y, x = np.meshgrid(k, k, indexing="ij")
    p = np.einsum("ji,jyx->iyx", matrix, np.stack((x, y, np.zeros_like(x))).astype(float)) + n // 2
    low = np.floor(p).astype(int)
    out = np.zeros((n, n), complex)
    for c in np.ndindex(2, 2, 2):
        at = low + np.array(c)[:, None, None]
        w = np.prod(np.where(np.array(c)[:, None, None] == 1, p - low, 1 - (p - low)), 0)
        ok = ((at >= 0) & (at < n)).all(0)
        i, j, l = np.clip(at, 0, n - 1)
        out += np.where(ok, w, 0) * f[l, j, i]
    return np.fft.fftshift(np.fft.ifftn(np.fft.ifftshift(out)).real)


def per_image(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], pixels: str = "pixels", shape: tuple[str, str] = ("ny", "nx")) -> DataFrame:
    """The table with a kernel applied to its images; images of one size in a batch go together, as (n, ny, nx)."""
    ship(df.sparkSession)
    kind = to_arrow_type(df.schema[pixels].dataType)

    def run(batches):
        for b in batches:
            sizes = list(zip(*(b.column(c).to_pylist() for c in shape), strict=True))
            data = b.column(pixels).to_pylist()
            out, new = [None] * len(data), list(sizes)
            for size in set(sizes):
                k = [i for i, s in enumerate(sizes) if s == size and data[i] is not None]
                if k:
                    got = kernel(np.array([data[i] for i in k], float).reshape(len(k), *size))
                    for i, a in zip(k, got, strict=True):
                        out[i], new[i] = a.ravel(), a.shape
            for name, col in ((pixels, pa.array(out, kind)), (shape[0], pa.array([s[0] for s in new], b.schema.field(shape[0]).type)), (shape[1], pa.array([s[1] for s in new], b.schema.field(shape[1]).type))):
                b = b.set_column(b.schema.names.index(name), name, col)
            yield b

    return df.mapInArrow(run, df.schema)


def power(a: np.ndarray) -> np.ndarray:
    """Squared amplitudes of the full transform, the mean at (0, 0)."""
    return np.abs(np.fft.fft2(a)) ** 2 / (a.shape[-1] * a.shape[-2]) ** 2


def laplacian_of_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """The negative Laplacian of the image smoothed by a Gaussian of sigma pixels: bright blobs of that size stand out."""
    k2 = (2 * np.pi * frequency(*a.shape[-2:])) ** 2
    return filtered(a, k2 * np.exp(-k2 * sigma * sigma / 2))


def whitened(a: np.ndarray) -> np.ndarray:
    """Every shell of rounded radius brought to a mean square amplitude of 1; empty shells stay 0."""
    f = np.fft.fft2(a)
    r = np.rint(np.hypot(*np.meshgrid(*[np.fft.fftfreq(n) * n for n in a.shape[-2:]], indexing="ij"))).astype(int)
    count = np.bincount(r.ravel())
    square = np.stack([np.bincount(r.ravel(), (np.abs(x) ** 2).ravel()) for x in f.reshape(-1, *a.shape[-2:])]) / count
    scale = np.where(square > 1e-20, 1 / np.sqrt(np.maximum(square, 1e-20)), 0.0)
    return np.fft.ifft2(f * scale[:, r].reshape(f.shape)).real


def phase_randomised(a: np.ndarray, beyond: float, seed: int = 0) -> np.ndarray:
    """Amplitudes kept, phases of frequencies of ``beyond`` cycles per pixel and more drawn anew; the same for each seed."""
    f = np.fft.rfft2(a)
    ny, nx = a.shape[-2:]
    noise = np.fft.rfft2(np.random.default_rng(seed).standard_normal((ny, nx)))
    turn = np.where(np.abs(noise) > 0, noise / np.maximum(np.abs(noise), 1e-300), 1.0)
    return np.fft.irfft2(np.where(frequency(ny, nx) >= beyond, np.abs(f) * turn, f), (ny, nx))


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Circular convolution with a kernel whose middle is at n // 2."""
    k = np.zeros(a.shape[-2:])
    h, w = kernel.shape
    k[:h, :w] = kernel
    return np.fft.irfft2(np.fft.rfft2(a) * np.fft.rfft2(np.roll(k, (-(h // 2), -(w // 2)), (0, 1))), a.shape[-2:])


def cross_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised correlation of images with one reference at every circular shift; 0 for constant images."""
    x, y = a - a.mean((-2, -1), keepdims=True), b - b.mean()
    scale = np.sqrt((x * x).sum((-2, -1), keepdims=True) * (y * y).sum())
    c = np.fft.irfft2(np.fft.rfft2(x) * np.fft.rfft2(y).conj(), a.shape[-2:])
    return np.where(scale > 1e-20, c / np.maximum(scale, 1e-20), 0.0)


def ctf_applied(a: np.ndarray, ctf: np.ndarray, phase_flip: bool = False) -> np.ndarray:
    """Images times a contrast transfer function on the full grid of frequencies, or times its signs."""
    return np.fft.ifft2(np.fft.fft2(a) * (np.where(ctf < 0, -1.0, 1.0) if phase_flip else ctf)).real


def centred(a: np.ndarray) -> np.ndarray:
    """Each image moved by whole pixels so that the centre of mass of its positive pixels is at n // 2."""
    ny, nx = a.shape[-2:]
    out = np.empty_like(a)
    for k, x in enumerate(a):
        p = np.maximum(x, 0)
        s = p.sum()
        cy, cx = ((p.sum(1) @ np.arange(ny)) / s, (p.sum(0) @ np.arange(nx)) / s) if s > 0 else (ny // 2, nx // 2)
        out[k] = np.roll(x, (int(np.floor(ny // 2 - cy + 0.5)), int(np.floor(nx // 2 - cx + 0.5))), (0, 1))
    return out


def shell_weighted(a: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Every coefficient times its shell's weight (rounded radius in coefficients; shells beyond the last get the last)."""
    ny, nx = a.shape[-2:]
    r = np.rint(np.hypot(*np.meshgrid(np.fft.fftfreq(ny) * ny, np.fft.fftfreq(nx) * nx, indexing="ij"))).astype(int)
    return np.fft.ifft2(np.fft.fft2(a) * np.asarray(weights)[np.minimum(r, len(weights) - 1)]).real


def blobs(a: np.ndarray, threshold: float) -> np.ndarray:
    """Connected parts (by edges) of the pixels that reach the threshold: 1 more than the index of a part's first pixel, 0 elsewhere."""
    ny, nx = a.shape[-2:]
    on = a >= threshold
    label = np.where(on, np.arange(1.0, ny * nx + 1).reshape(ny, nx), np.inf)
    while True:
        p = np.pad(label, ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
        new = np.minimum.reduce([p[:, 1:-1, 1:-1], p[:, :-2, 1:-1], p[:, 2:, 1:-1], p[:, 1:-1, :-2], p[:, 1:-1, 2:]])
        new = np.where(on, new, np.inf)
        if (new == label).all():
            return np.where(on, label, 0.0)
        label = new


def wiener_divided(a: np.ndarray, ctf: np.ndarray, noise: float) -> np.ndarray:
    """Images divided by a transfer function where that is strong: times ctf / (ctf squared + noise)."""
    return np.fft.ifft2(np.fft.fft2(a) * ctf / (ctf * ctf + noise)).real


def gridding_corrected(a: np.ndarray, padding: float, order: int = 2) -> np.ndarray:
    """Images divided by what interpolation in a padded transform does to them: a power of sinc of the distance from n // 2."""
    ny, nx = a.shape[-2:]
    r = np.hypot((np.arange(ny) - ny // 2)[:, None] / (padding * ny), (np.arange(nx) - nx // 2)[None] / (padding * nx))
    return a / np.sinc(r) ** order


def subtracted(a: np.ndarray, reference: np.ndarray, ctf: np.ndarray) -> np.ndarray:
    """Images less a reference as the microscope would have shown it."""
    return a - np.fft.ifft2(np.fft.fft2(reference) * ctf).real


def smaller(a: np.ndarray, sigma: float) -> np.ndarray:
    """The next level of a pyramid: smoothed by a Gaussian of sigma pixels, every second pixel kept."""
    return filtered(a, np.exp(-2 * (np.pi * sigma * frequency(*a.shape[-2:])) ** 2))[..., ::2, ::2]

"""Fourier space: transforms, spectra, projections, collocation, Poisson, random fields."""

from .complexes import Z
from .derivs import SpectralCollocator
from .dft import DFT, fftfreq
from .poisson import SpectralPoissonSolver
from .projectors import Projector, tensor_index
from .rayleigh import RayleighGenerator, make_hermitian
from .spectra import PowerSpectra

__all__ = ["DFT", "PowerSpectra", "Projector", "RayleighGenerator", "SpectralCollocator", "SpectralPoissonSolver", "Z", "fftfreq", "make_hermitian", "tensor_index"]

"""Pixel kernels on numpy arrays: binary images have ink 0 and background 255, colour is blue, green, red."""

"""Column functions without Python UDFs, and driver-side pattern compilers."""

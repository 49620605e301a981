"""Column functions: index arithmetic, differencing codes and bits."""

"""DataFrame in, DataFrame out. Every operator is lazy and takes its point in time as an argument."""

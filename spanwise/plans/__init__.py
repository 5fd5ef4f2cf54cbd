"""A cost model for executing band joins bucket by bucket in fixed-size vectors, as DataFrame transformations.

A bucket has n_b rows on one side and m_b on the other. A vector has `slots` places in two rows of half as many.
"""

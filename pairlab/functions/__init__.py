from pairlab.functions.metrics import (  # noqa: F401
    bleu,
    bleu_from_tokens,
    bleu_tokens,
    clipped_overlap,
    is_unrelated,
    lcs_length,
    ngrams,
    rouge_l,
    rouge_l_tokens,
    rouge_n,
    rouge_n_tokens,
    rouge_tokens,
)
from pairlab.functions.text import (  # noqa: F401
    array_mean,
    default_stop_words,
    keep_tokens,
    lexical_tokens,
    sentences_of,
    tokens_per_sentence,
    word_tokens,
)

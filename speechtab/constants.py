"""Fixed values. They must equal the published corpus contract for results to match."""

# Alphabets, in id order. Id 0 is the blank, id 1 the space.
SERBIAN_LETTERS = " abcčćdđefghijklmnoprsštuvzž"
ENGLISH_LETTERS = " ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANK_SYMBOL = "<blank>"
BLANK_ID = 0
SPACE_ID = 1

# Characters that separate words.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Tokens that mark silence in annotations.
SILENCE_TOKENS = ("sil", "sp")
LEGACY_SILENCE_TOKENS = ("sil",)

# Language-model tokens.
LM_SPACE = "<sp>"
LM_START = "<s>"
LM_END = "</s>"
LM_UNKNOWN = "<unk>"
LM_ORDER = 5

# Smallest box extent, box margins (x, y) and sampling band of a clip.
MIN_BOX_EXTENT = (0.04, 0.025)
BOX_MARGIN = (1.55, 2.0)
SAMPLE_BAND = (0.15, 0.7)

# Split shares and seed.
HOLDOUT_SHARE = 0.15
SPLIT_SEED = 42

# Grid searched when tuning the rescoring weights.
TUNING_ALPHAS = (1.0, 1.25, 1.5, 1.75)
TUNING_BETAS = (0.0, 0.5, 1.0, 1.5, 2.0)

# 51-point frontal face template (unit coordinates), padding and crop.
TEMPLATE_X = (
    0.000213256, 0.0752622, 0.18113, 0.29077, 0.393397, 0.586856, 0.689483, 0.799124, 0.904991,
    0.98004, 0.490127, 0.490127, 0.490127, 0.490127, 0.36688, 0.426036, 0.490127, 0.554217,
    0.613373, 0.121737, 0.187122, 0.265825, 0.334606, 0.260918, 0.182743, 0.645647, 0.714428,
    0.793132, 0.858516, 0.79751, 0.719335, 0.254149, 0.340985, 0.428858, 0.490127, 0.551395,
    0.639268, 0.726104, 0.642159, 0.556721, 0.490127, 0.423532, 0.338094, 0.290379, 0.428096,
    0.490127, 0.552157, 0.689874, 0.553364, 0.490127, 0.42689,
)
TEMPLATE_Y = (
    0.106454, 0.038915, 0.0187482, 0.0344891, 0.0773906, 0.0773906, 0.0344891, 0.0187482, 0.038915,
    0.106454, 0.203352, 0.307009, 0.409805, 0.515625, 0.587326, 0.609345, 0.628106, 0.609345,
    0.587326, 0.216423, 0.178758, 0.179852, 0.231733, 0.245099, 0.244077, 0.231733, 0.179852,
    0.178758, 0.216423, 0.244077, 0.245099, 0.780233, 0.745405, 0.727388, 0.742578, 0.727388,
    0.745405, 0.780233, 0.864805, 0.902192, 0.909281, 0.902192, 0.864805, 0.784792, 0.778746,
    0.785343, 0.778746, 0.784792, 0.824182, 0.831803, 0.824182,
)
TEMPLATE_PADDING = 0.25
TEMPLATE_SIZE = 256
MOUTH_CROP = (160, 80)

# Parameter groups of a model inventory, by name prefix.
PARAMETER_GROUPS = {
    "conv_early": ("conv1.", "conv2."),
    "conv3": ("conv3.",),
    "gru1": ("gru1.",),
    "gru2": ("gru2.",),
    "head": ("FC.",),
}

"""Declared schemas (Spark DDL) of landed files, documents and work tables."""

CONFIG = (
    "channels ARRAY<STRUCT<url: STRING, category: STRING, priority: INT>>, "
    "settings STRUCT<maxVideosPerChannel: INT, includeShorts: BOOLEAN, includePrivate: BOOLEAN, "
    "skipShortThumbnails: BOOLEAN>"
)

RAW_OWNER = """
id STRING,
snippet STRUCT<title: STRING, description: STRING, customUrl: STRING, country: STRING, publishedAt: STRING,
  thumbnails: STRUCT<`default`: STRUCT<url: STRING>, medium: STRUCT<url: STRING>, high: STRUCT<url: STRING>>>,
statistics STRUCT<subscriberCount: STRING, hiddenSubscriberCount: BOOLEAN, videoCount: STRING, viewCount: STRING>,
brandingSettings STRUCT<image: STRUCT<bannerExternalUrl: STRING>>
"""

RAW_ITEM = """
id STRING,
channelId STRING,
snippet STRUCT<title: STRING, description: STRING, publishedAt: STRING,
  thumbnails: STRUCT<`default`: STRUCT<url: STRING>, medium: STRUCT<url: STRING>, high: STRUCT<url: STRING>,
    standard: STRUCT<url: STRING>, maxres: STRUCT<url: STRING>>,
  tags: ARRAY<STRING>, categoryId: STRING, defaultLanguage: STRING, defaultAudioLanguage: STRING>,
contentDetails STRUCT<duration: STRING, definition: STRING, caption: STRING, licensedContent: BOOLEAN>,
statistics STRUCT<viewCount: STRING, likeCount: STRING, commentCount: STRING>,
topicDetails STRUCT<topicCategories: ARRAY<STRING>>,
status STRUCT<madeForKids: BOOLEAN>
"""

RAW_PAGE = """
channelId STRING, page INT, nextPageToken STRING, totalResults BIGINT,
items ARRAY<STRUCT<videoId: STRING, publishedAt: STRING, title: STRING, description: STRING>>
"""

# The image document (130 leaves) and the title/description
# document (76 leaves) that an annotation run returns.
IMAGE_DOCUMENT = """
scene STRUCT<settingType: STRING, location: STRING, backgroundElements: ARRAY<STRING>, timeOfDay: STRING, props: ARRAY<STRING>, thumbnailStyle: STRING, contentCategory: STRING>,
composition STRUCT<layoutType: STRING, gridStructure: STRING, visualBalance: STRING, negativeSpace: STRING, complexity: STRING, focalPoint: ARRAY<STRING>, depthOfField: STRING>,
humanPresence STRUCT<facePresent: BOOLEAN, faceCount: INT, facePosition: STRING, faceSize: STRING, faceCoverage: DOUBLE, expression: STRING, expressionIntensity: STRING, mouthOpen: BOOLEAN, eyeContact: BOOLEAN, eyebrowsRaised: BOOLEAN, bodyVisible: BOOLEAN, bodyPortion: STRING, handVisible: BOOLEAN, handGesture: STRING, pointingAt: STRING, lookingDirection: STRING>,
textElements STRUCT<hasText: BOOLEAN, textCount: INT, primaryText: STRUCT<content: STRING, language: STRING, script: STRING, position: STRING, size: STRING, color: STRING, backgroundColor: STRING, hasOutline: BOOLEAN, fontStyle: STRING, allCaps: BOOLEAN, readable: BOOLEAN>, languages: ARRAY<STRING>, hasTeluguScript: BOOLEAN, hasEnglishText: BOOLEAN, hasNumbers: BOOLEAN, numberValue: STRING, numberType: STRING, hasEmoji: BOOLEAN, emojiList: ARRAY<STRING>, textPurpose: ARRAY<STRING>, totalTextCoverage: DOUBLE>,
colors STRUCT<dominantColors: ARRAY<STRUCT<hex: STRING, name: STRING, percentage: DOUBLE>>, palette: STRING, mood: STRING, contrast: STRING, saturation: STRING, brightness: STRING, backgroundType: STRING, backgroundColor: STRING, colorHarmony: STRING, contrastWithYouTube: BOOLEAN>,
food STRUCT<foodPresent: BOOLEAN, foodCount: INT, mainDish: STRING, dishCategory: STRING, cuisineType: STRING, presentation: STRING, platingStyle: STRING, container: STRING, steam: BOOLEAN, sizzle: BOOLEAN, garnished: BOOLEAN, garnishes: ARRAY<STRING>, freshness: STRING, appetiteAppeal: INT, colorVibrancy: STRING, textureVisible: BOOLEAN, portionSize: STRING, cookingStage: STRING>,
graphics STRUCT<hasArrows: BOOLEAN, arrowCount: INT, arrowColor: STRING, arrowStyle: STRING, arrowPointingTo: STRING, hasCircles: BOOLEAN, hasHighlights: BOOLEAN, hasBorder: BOOLEAN, borderColor: STRING, borderStyle: STRING, hasBadge: BOOLEAN, badgeType: STRING, badgeText: STRING, hasLogo: BOOLEAN, logoPosition: STRING, hasBeforeAfter: BOOLEAN, hasVsComparison: BOOLEAN, hasSplitScreen: BOOLEAN, hasGlow: BOOLEAN, hasShadow: BOOLEAN>,
branding STRUCT<channelLogoVisible: BOOLEAN, logoPlacement: STRING, channelNameVisible: BOOLEAN, recognizableStyle: BOOLEAN, professionalQuality: STRING>,
psychology STRUCT<curiosityGap: BOOLEAN, socialProof: BOOLEAN, urgency: BOOLEAN, scarcity: BOOLEAN, authority: BOOLEAN, controversy: BOOLEAN, transformation: BOOLEAN, luxury: BOOLEAN, nostalgia: BOOLEAN, shock: BOOLEAN, humor: BOOLEAN, fear: BOOLEAN, aspiration: BOOLEAN, relatability: BOOLEAN, primaryEmotion: STRING, emotionalIntensity: STRING, clickMotivation: ARRAY<STRING>, targetAudience: ARRAY<STRING>>,
technicalQuality STRUCT<resolution: STRING, sharpness: STRING, lighting: STRING, noiseLevel: STRING, framing: STRING, exposure: STRING>
"""

TITLE_DOCUMENT = """
structure STRUCT<pattern: STRING, patternType: STRING>,
language STRUCT<hasTransliteration: BOOLEAN, transliteratedWords: STRING, codeSwitch: BOOLEAN, codeSwitchStyle: STRING, teluguWords: STRING, teluguWordCount: INT, teluguReadability: STRING, englishWords: STRING, englishWordCount: INT>,
hooks STRUCT<questionType: STRING, questionWord: STRING, numberContext: STRING, hasPowerWord: BOOLEAN, powerWords: STRING, powerWordCategories: STRING, triggers: STRUCT<curiosityGap: BOOLEAN, socialProof: BOOLEAN, urgency: BOOLEAN, exclusivity: BOOLEAN, controversy: BOOLEAN, transformation: BOOLEAN, challenge: BOOLEAN, comparison: BOOLEAN, personal: BOOLEAN, storytelling: BOOLEAN>, hookStrength: STRING, primaryHook: STRING>,
keywords STRUCT<primaryKeyword: STRING, primaryKeywordPosition: STRING, secondaryKeywords: STRING, searchIntent: STRING, niche: STRING, subNiche: STRING, microNiche: STRING, evergreen: BOOLEAN, seasonal: BOOLEAN, trendingPotential: STRING, keywordCompetition: STRING, seoOptimized: BOOLEAN, keywordInFirst3Words: BOOLEAN, naturalLanguage: BOOLEAN>,
contentSignals STRUCT<contentType: STRING, isRecipe: BOOLEAN, isTutorial: BOOLEAN, isReview: BOOLEAN, isVlog: BOOLEAN, isChallenge: BOOLEAN, isReaction: BOOLEAN, isComparison: BOOLEAN, isList: BOOLEAN, isStorytime: BOOLEAN, isTravel: BOOLEAN, isInterview: BOOLEAN, isEducational: BOOLEAN, isMusicRelated: BOOLEAN, isPartOfSeries: BOOLEAN, seriesName: STRING, episodeNumber: STRING, hasCollaboration: BOOLEAN, collaboratorMentioned: STRING, hasBrandMention: BOOLEAN, brandMentioned: STRING, brandPosition: STRING>,
descriptionAnalysis STRUCT<structure: STRUCT<wellOrganized: BOOLEAN, firstLineHook: BOOLEAN>, recipeContent: STRUCT<hasIngredients: BOOLEAN, ingredientCount: INT, hasInstructions: BOOLEAN, instructionSteps: INT, hasCookingTime: BOOLEAN>, ctas: STRUCT<commentQuestion: STRING>, seo: STRUCT<keywordInFirst100Chars: BOOLEAN, keywordDensity: DOUBLE, internalLinking: STRING>>
"""


def struct_type(ddl: str):
    """Schema of a DDL string (needs an active session)."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)
